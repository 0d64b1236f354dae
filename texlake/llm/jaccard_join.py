"""Exact Jaccard join on word shingles by partitioned universes, and the components of its links.

Two sets of sizes a and b that reach the threshold differ in at most H = (a + b)(1 - t) / (1 + t) elements. Their
universe (the shingle hashes) is dealt into m segments, so the H differences cannot touch all of them:

* sets fall into size bands; a band and all sets that may match one of its sets use the same m;
* larger bands: m = H + 1 + e segments, so at least e + 1 are equal;
* small bands: m = H / 2 + 1 + e segments, each with its one-deletion neighbourhood: at least e + 1 of them differ in at
  most one element, and share a signature. Their segments are twice as large, which short texts need to be told apart.

Signatures cost what they match: once all are counted, each set drops the e most frequent of its own in each band. That
order (count, then signature) is the same for every set, so what two sets drop of their common signatures is a common
prefix of at most e, and one is left. What goes is what boilerplate, shared passages and empty segments cause.

The choice is by cost: the deletion form writes as many signatures as the set has elements, the other one a sixth of
that. Sets that share a signature are candidates and are verified on their texts. What thousands of near copies of one
text share says nothing; they are told apart by a second index, of their differences from the text in their middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import batches_of, drop, free_name, fresh_worker, list_column, partitions, text_key, written
from .components import components

#: Bands up to this size use one-deletion neighbourhoods.
DELETION_BAND = 64
#: Bytes of text that are worked on at once.
SLICE = 1_000_000
_GROWTH = 1.5


def _bands(most: int) -> np.ndarray:
    """Upper ends of the size bands."""
    ends = [6]
    while ends[-1] < most:
        ends.append(int(ends[-1] * _GROWTH) + 1)
    return np.array(ends, np.int64)


def spare(apart, deletes):
    """How many common signatures more than one there are at least, and how many of its own a set may drop."""
    return np.where(deletes, 2, 2 + apart // 2)


def _spare_of_bands(num: int, den: int) -> list[int]:
    """``spare`` of each band, up to sets of 2**31."""
    ends = _bands(1 << 31)
    return spare(2 * ends * (den - num) // (den + num), ends <= DELETION_BAND).tolist()


def signatures(values: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets laid end to end (``sizes`` elements each), their band in the low 6 bits, and the set of each."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(sizes) or not sizes.max():
        return none
    ends = _bands(int(sizes.max()) * den // num + 1)
    most_apart = 2 * ends * (den - num) // (den + num)
    band = np.searchsorted(ends, sizes)
    # a set signs its own band and every further one up to that of the largest set it may match
    further = np.where(sizes > 0, np.searchsorted(ends, sizes * den // num) - band, -1)
    steps = [(np.flatnonzero(further >= k), k) for k in range(int(further.max()) + 1)]
    owner = np.concatenate([who for who, _ in steps])
    scheme = np.concatenate([band[who] + k for who, k in steps])
    use = most_apart[scheme] > 0  # no difference allowed: equal sets only, and those are one node
    owner, scheme = owner[use], scheme[use]
    if not len(owner):
        return none
    apart = most_apart[scheme]
    deletes = ends[scheme] <= DELETION_BAND
    m = np.where(deletes, apart // 2, apart) + 1 + spare(apart, deletes)
    base = np.cumsum(m) - m
    first = np.cumsum(sizes) - sizes
    n = sizes[owner]
    row = np.repeat(np.arange(len(owner)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[owner][row]
    element = hashing.mix(values[at] ^ np.uint64(0x5851F42D4C957F2D))
    slot = base[row] + ((element >> np.uint64(20)) % m[row].astype(np.uint64)).astype(np.int64)
    total, count = np.zeros(int(m.sum()), np.uint64), np.bincount(slot, minlength=int(m.sum()))
    weight = hashing.mix(element + np.uint64(0x2545F4914F6CDD1D))
    np.add.at(total, slot, weight)
    of = np.repeat(np.arange(len(owner)), m)
    place = hashing.mix((scheme[of].astype(np.uint64) << np.uint64(40)) + (np.arange(len(of)) - base[of]).astype(np.uint64))
    spread = np.uint64(0x9E3779B97F4A7C15)
    whole = hashing.mix(total + place + count.astype(np.uint64) * spread)
    one_less = deletes[row]
    near = hashing.mix((total[slot] - weight + place[slot] + (count[slot] - 1).astype(np.uint64) * spread)[one_less])
    signs, by = np.concatenate([whole, near]), np.concatenate([of, row[one_less]])
    return signs & ~np.uint64(63) | scheme[by].astype(np.uint64), owner[by]


def _shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batches with their shingles, the row of each, and of each row the size, the node, and whether its set is new to the batch."""
    fresh_worker()
    for whole in batches:
        seen: set[int] = set()
        for batch, data, offsets in batches_of(whole, "body", SLICE):
            words, owner = hashing.word_hashes(data, offsets)
            values, who = hashing.distinct_pairs(*hashing.shingles(words, owner, width))
            sizes = np.bincount(who, minlength=batch.num_rows).astype(np.int64)
            sums = np.zeros(batch.num_rows, np.uint64)
            np.add.at(sums, who, hashing.mix(values + np.uint64(0x632BE59BD9B4E019)))
            node = hashing.mix(sums + sizes.astype(np.uint64)).view(np.int64)
            new = np.zeros(batch.num_rows, bool)
            for k in np.flatnonzero(sizes):
                if int(node[k]) not in seen:
                    seen.add(int(node[k]))
                    new[k] = True
            yield batch, values, who, sizes, node, new


def _sets(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, sizes, node, _ in _shingled(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64(), mask=sizes == 0), pa.array(sizes, pa.int64())], names=["doc_id", "key", "node", "n_shingles"])

    return read


def _signs(width: int, num: int, den: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, who, sizes, node, new in _shingled(batches, width):  # equal sets of a batch sign once
            signs, by = signatures(values[new[who]], np.where(new, sizes, 0), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(signs.view(np.int64)), pa.array(node[by])], names=["sign", "node"])

    return read


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sign, node): those of signatures that more than one node has, each pair once."""
    sign, node, shared = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        s = np.concatenate([sign, batch.column("sign").to_numpy(zero_copy_only=False)])
        v = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
        if not len(s):
            continue
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        held = shared if len(sign) else False
        s, v = s[first], v[first]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        same[0] = held
        out = (same[:-1] | same[1:])[:-1]  # the last row waits for what follows it
        yield pa.RecordBatch.from_arrays([pa.array(s[:-1][out]), pa.array(v[:-1][out])], names=["sign", "node"])
        sign, node, shared = s[-1:], v[-1:], bool(same[-2])
    if shared:
        yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(node)], names=["sign", "node"])


def _verify(width: int, num: int, den: int, with_elements: bool):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lead, node, body) by lead, the lead's own row first; out come how far the others are from it."""
        fresh_worker()
        own = np.zeros(0, np.uint64)
        for whole in batches:
            for batch, data, offsets in batches_of(whole, "body", SLICE):
                words, owner = hashing.word_hashes(data, offsets)
                values, who = hashing.distinct_pairs(*hashing.shingles(words, owner, width))
                sizes = np.bincount(who, minlength=batch.num_rows)
                ends = np.cumsum(sizes)
                leads, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "node"))
                found, apart, lead_size = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                elements: list[np.ndarray] = []
                cuts = np.flatnonzero(np.concatenate([[True], (nodes == leads)[1:], [True]]))
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if nodes[a] == leads[a]:
                        own = values[ends[a] - sizes[a] : ends[a]]
                    begin = ends[a] - sizes[a]
                    part = values[begin : ends[z - 1]]
                    place = np.minimum(np.searchsorted(own, part), max(0, len(own) - 1))
                    hit = own[place] == part if len(own) else np.zeros(len(place), bool)
                    common = np.bincount(who[begin : ends[z - 1]][hit] - a, minlength=z - a)
                    lead_size[a:z] = len(own)
                    apart[a:z] = len(own) + sizes[a:z] - 2 * common
                    found[a:z] = (common > 0) & (den * common >= num * (len(own) + sizes[a:z] - common))
                    for k in range(a, z) if with_elements else ():
                        if nodes[k] != leads[k]:
                            mine = slice(ends[k] - sizes[k] - begin, ends[k] - begin)
                            left = np.ones(len(own), bool)
                            left[place[mine][hit[mine]]] = False
                            elements += [own[left], part[mine][~hit[mine]]]
                out = nodes != leads
                columns = [pa.array(x[out], pa.int64()) for x in (leads, nodes, apart, sizes.astype(np.int64), lead_size)]
                names = ["lead", "node", "apart", "size", "lead_size", "linked"]
                columns.append(pa.array(found[out]))
                if with_elements:
                    names.append("elements")
                    columns.append(list_column(np.concatenate([*elements, np.zeros(0, np.uint64)]).view(np.int64), apart[out], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return verify


def _measured(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int, with_elements: bool = False) -> DataFrame:
    """The pairs (lead, node) with the size of their symmetric difference (and its elements), both sizes and whether they link."""
    n = partitions(pairs.sparkSession)
    # a lead of very many pairs is dealt over parts of some hundreds, each with the lead's text
    parts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / 400).cast("int").alias("parts"))
    own = parts.select("lead", F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = pairs.join(parts, "lead").select("lead", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    rows = others.unionByName(own).join(texts, "node").select("lead", "part", "node", "body")
    dealt = rows.repartition(n, "lead", "part").sortWithinPartitions("lead", "part", F.col("node") != F.col("lead"), "node")
    schema = "lead long, node long, apart long, size long, lead_size long, linked boolean" + ", elements array<long>" * with_elements
    return dealt.mapInArrow(_verify(width, num, den, with_elements), schema)


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, rounds: int = 1) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their word shingles of at least num / den.

    Takes doc_id (any integer type) and text; returns one row per input row: doc_id, n_shingles (size of its set of
    ``width``-word shingles of the words between ASCII white space, A-Z lower-cased), component_id (smallest doc_id
    reachable by links, itself included). With fewer than ``width`` words the whole sequence is the one shingle; null
    texts and texts without words have no shingle and no link (component_id is the own doc_id). Repeated rows and equal
    texts share a component; null doc_ids are ignored in minima; extra columns are ignored; an empty table gives an
    empty result. Shingles are compared by 64-bit hashes of whole words, equal sets are one node.

    No pair is left out: members of a signature are compared with a lead in each of some ``rounds``, and those that then
    still stand in different components by what they have and lack against a common lead (``_further``).
    """
    named, _ = _named(docs, width, num, den, rounds)
    least = named.where("node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _named(docs: DataFrame, width: int, num: int, den: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key (text_key), node, n_shingles, component (the least node reachable; null without words) of every row, and
    the written table that this reads."""
    n = partitions(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text_key().alias("key"), text.cast("binary").alias("body"))
    sets = written(rows.mapInArrow(_sets(width), f"doc_id {kind.simpleString()}, key binary, node long, n_shingles long"), "sets")
    # signatures are eight times as many bytes as the sets without them: shuffled, never written, though texts are cut into words again
    signs = rows.select("body").mapInArrow(_signs(width, num, den), "sign long, node long")
    dealt = signs.repartition(n, "sign").sortWithinPartitions("sign", "node")
    shared = written(dealt.mapInArrow(_members, "sign long, node long"), "shared")
    members = written(_cheapest(shared, _spare_of_bands(num, den)), "members")
    drop(shared)
    links = _links(docs, sets, members, width, num, den, rounds)
    drop(members)
    nodes = sets.select("doc_id", "key", "node", "n_shingles")
    return nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node")), sets


def _cheapest(shared: DataFrame, spares: list[int]) -> DataFrame:
    """Without the most frequent signatures of each node and band, as many as may be dropped."""
    counts = shared.groupBy("sign").agg(F.count(F.lit(1)).alias("n"))
    band = F.col("sign").bitwiseAND(F.lit(63)).cast("int")
    rank = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "sign"))
    rows = shared.join(counts, "sign").withColumn("band", band).withColumn("r", rank)
    return rows.where(F.col("r") > F.get(F.array(*map(F.lit, spares)), F.col("band"))).select("sign", "node")


def one_of_each_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, rounds: int = 1) -> DataFrame:
    """Exactly one row of ``docs``, all columns as they are, of each group of ``jaccard_groups``.

    It is one of the smallest doc_id and, of these, of the least text_key; null doc_ids come last. Of repeated rows (same
    doc_id, same text) any one stays. Rows without words have no group: repeated ones become one, those of null doc_id stay.
    """
    named, sets = _named(docs, width, num, den, rounds)
    # repeated rows are one row from here on
    counted = written(named.groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "counted")
    drop(sets)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = counted.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("l"), F.count(F.lit(1)).alias("size")).where("size > 1")
    later = counted.join(least, "component").where(~(F.col("doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("key") == F.col("l.key"))))
    gone = later.select("doc_id", "key")
    repeated = counted.where("n > 1 AND (doc_id IS NOT NULL OR component IS NOT NULL)").select("doc_id", "key")
    gone, repeated = written(gone, "gone"), written(repeated, "repeated")
    drop(counted)
    key, row, gone_id, gone_key = (free_name(docs.columns, name) for name in ("_key", "_row", "_gone_id", "_gone_key"))
    keyed = docs.withColumn(key, text_key())

    def same(table: DataFrame) -> tuple:
        t = table.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
        if table.count() <= 1_000_000:  # some fifty bytes each
            t = F.broadcast(t)
        return t, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))

    once = keyed.join(*same(gone.unionByName(repeated)), "left_anti").select(docs.columns)
    again = keyed.join(*same(repeated.exceptAll(gone)), "left_semi")
    one = again.select("doc_id", key, F.struct(*docs.columns).alias(row)).groupBy("doc_id", key).agg(F.first(row).alias(row))
    return once.unionByName(one.select(f"{row}.*"))


def _links(docs: DataFrame, sets: DataFrame, members: DataFrame, width: int, num: int, den: int, rounds: int) -> DataFrame:
    """node, component of every node that links with another one."""
    candidates = members.select("node").distinct()
    picked = written(sets.join(candidates, "node").groupBy("node").agg(F.min("key").alias("key")), "picked")
    wanted = picked.select("key")
    if picked.count() <= 1_000_000:  # some fifty bytes each
        wanted = F.broadcast(wanted)
    bodies = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    bodies = bodies.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("body").alias("body"))
    texts = written(picked.join(bodies, "key").select("node", "body"), "texts")
    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    now = members.withColumn("component", F.col("node"))
    for turn in range(rounds + 1):
        if turn < rounds:
            pairs = written(now.join(_leads(now, turn), "sign").where("node <> l.node AND component <> l.component").select(F.col("l.node").alias("lead"), "node").distinct(), "pairs")
            found = written(_measured(pairs, texts, width, num, den).where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b")), "found")
            drop(pairs)
        else:
            found = _further(now, texts, width, num, den)
        labels = components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        drop(found, now)
        if turn < rounds:
            now = written(_unsettled(members, labels), "open")
            if now.isEmpty():
                break
    drop(picked, texts, now)
    return labels


def _leads(members: DataFrame, turn: int) -> DataFrame:
    """sign, l (h, node, component): the node of each signature that the others are compared with in a turn."""
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node"), F.col("component"))
    return members.groupBy("sign").agg(F.min(order).alias("l"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the signatures whose nodes lie in more than one component."""
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("sign").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sign")
    return named.join(mixed, "sign", "left_semi").select("sign", "node", "component")


def _further(now: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The links (a, b) that members of the same signature have, but those that other links of theirs imply.

    Of each signature the node with the most company is the lead, which near copies of one text mostly share. A set is its
    difference from the lead: |A - B| = |dA| + |dB| - 2 |dA & dB| (symmetric differences), so with
    u = |d| (den + num) - |set| (den - num), two sets link if and only if 2 (den + num) |dA & dB| >= uA + uB. Sets that
    link with the lead need no further comparison among each other. Of any other pair, the one of larger u doesn't link
    with the lead; they must share so many elements of their differences that the rarest ones of either, as many as can
    be without a share, have one in common. Elements that only one set of the lead has in its difference don't count.
    """
    s, d = num + den, den - num
    company = now.join(now.groupBy("sign").agg(F.count(F.lit(1)).alias("n")), "sign").groupBy("node").agg(F.sum("n").alias("company"))
    led = now.join(company, "node")
    lead = led.groupBy("sign").agg(F.max(F.struct("company", "node")).alias("l"))
    pairs = written(led.join(lead, "sign").select(F.col("l.node").alias("lead"), "node", "component").where("node <> lead").distinct(), "pairs")
    apart = written(_measured(pairs.select("lead", "node"), texts, width, num, den, with_elements=True), "apart")
    near = apart.where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    u = (F.col("apart") * s - F.col("size") * d).alias("u")
    rated = apart.select("lead", "node", u, (F.col("lead_size") * d).alias("edge"), "linked", "elements")
    far = rated.where("NOT linked").select("lead").distinct()
    elements = rated.join(far, "lead", "left_semi").select("lead", "node", F.explode("elements").alias("e"))
    common = elements.groupBy("lead", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = elements.join(common, ["lead", "e"]).groupBy("lead", "node").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))
    sized = lists.join(rated.drop("elements"), ["lead", "node"]).join(pairs, ["lead", "node"])
    sized = written(sized.select("lead", "node", "component", "u", "edge", "linked", F.size("es").cast("long").alias("k"), F.transform("es", lambda x: x["e"]).alias("es")), "sized")

    def rare(sets: DataFrame, least: Column, side: str) -> DataFrame:
        """The elements of which one is shared with every set that shares at least ``least``."""
        rows = sets.withColumn("least", F.ceil(least / (2 * s))).where("k >= least")
        first = F.slice("es", F.lit(1), (F.col("k") - F.col("least") + 1).cast("int"))
        named = rows.select("lead", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "u", "k")], F.posexplode(first).alias("at", "e"))
        return named.withColumn(f"rest_{side}", F.col(f"k_{side}") - F.col("at")).drop("at", f"k_{side}")

    low = rare(sized, F.col("u") + F.greatest(F.col("u"), F.col("edge") + 1), "a")
    high = rare(sized.where("NOT linked"), F.greatest(F.lit(1), F.col("u") + 2 * num - F.col("edge")), "b")
    ordered = (F.col("u_a") < F.col("u_b")) | ((F.col("u_a") == F.col("u_b")) & (F.col("node_a") < F.col("node_b")))
    enough = 2 * s * F.least("rest_a", "rest_b") >= F.col("u_a") + F.col("u_b")
    found = low.join(high, ["lead", "e"]).where(ordered & enough & (F.col("component_a") != F.col("component_b")))
    last = written(found.select(F.col("node_a").alias("lead"), F.col("node_b").alias("node")).distinct(), "last")
    exact = _measured(last, texts, width, num, den).where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = written(near.unionByName(exact), "found")
    drop(pairs, apart, sized, last)
    return links
