"""Token counts of whole texts by a sentencepiece model; huge texts in overlapping chunks that are spliced again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache


class Counter:
    """Counts tokens as ``len(encode(text))`` does.

    A text of more than ``chunk`` characters is cut into chunks that overlap by ``overlap``. Both chunks of an overlap
    are encoded with offsets; they are spliced at a place where each has a token border and which is *proven stable*:
    no piece of the vocabulary holds the two characters around it side by side, so no merge can ever cross it, whatever
    stands elsewhere. If an overlap has no such place, or the chunks disagree there, the overlap is doubled, at last to
    the whole text. A model that rewrites texts (other than blanks as U+2581) proves nothing; its texts are encoded whole.
    """

    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 256):
        from sentencepiece import SentencePieceProcessor

        self.model, self.chunk, self.overlap = SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in pieces if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.pairs = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        # the normaliser may write blanks as U+2581 and put one in front, and nothing else
        probe = "a  b \té\u00a0\u3000Ａ ﬁ e\u0301 "
        self.plain = self.model.normalize(probe).replace("▁", " ").removeprefix(" ") == probe

    def _stable(self, left: str, right: str) -> bool:
        return left.replace(" ", "▁") + right.replace(" ", "▁") not in self.pairs

    def _borders(self, text: str) -> tuple[dict[int, int], int]:
        """Tokens before each token border of a text, and all of them."""
        places = self.model.encode(text, return_type="offset_mapping")["offsets"]
        borders, at = {}, 0
        for k, (begin, end) in enumerate(places):
            if begin >= at:  # the byte tokens of one character share its place; the first of them counts
                borders.setdefault(begin, k)
            at = end
        borders[len(text)] = len(places)
        return borders, len(places)

    def _long(self, text: str) -> int:
        n, total, start, skip = len(text), 0, 0, 0
        here, count = self._borders(text[: self.chunk])
        end = min(self.chunk, n)
        while end < n:
            overlap = self.overlap
            while True:
                low = max(start, end - overlap)
                next_end = min(n, low + self.chunk)
                there, more = self._borders(text[low:next_end])
                cut = next((p for p in range(low + overlap // 4 + 1, end) if self._stable(text[p - 1], text[p]) and p - start in here and p - low in there and here[p - start] >= skip), None)
                if cut is not None:
                    break
                if overlap >= n:
                    return len(self.model.encode(text))
                overlap *= 2
                if end - overlap <= start:  # the overlap has grown over the chunk before it
                    return len(self.model.encode(text))
            total += here[cut - start] - skip
            skip, here, count, start, end = there[cut - low], there, more, low, next_end
        return total + count - skip

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk or not self.plain]
        found = iter(map(len, self.model.encode(short, num_threads=1))) if short else iter(())
        return [next(found) if len(t) <= self.chunk or not self.plain else self._long(t) for t in texts]


_counters: dict[tuple, Counter] = worker_cache()


def counter(*key) -> Counter:
    """This worker's counter for a model, kept between tasks."""
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of ``docs`` (doc_id, text).

    Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated rows; extra columns are ignored. No
    shuffle: each task encodes the texts it reads, a chunk of a huge one at once as long as overlaps can be spliced.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model, chunk, overlap).counts
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts([t or "" for t in part.column("text").to_pylist()]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
