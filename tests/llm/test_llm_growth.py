"""What keeps the operators' disk and plans in proportion."""

import random

import pytest

from texlake.llm import components as C
from texlake.llm import jaccard_join


def test_sets_are_written_without_their_signatures(spark, monkeypatch):
    written, kinds = jaccard_join.written, {}

    def recorded(df, name="cut"):
        kinds[name] = [f.dataType.typeName() for f in df.schema]
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "written", recorded)
    words = [f"w{k}" for k in range(60)]
    t = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:59])), (3, " ".join(words)), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(t).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert "array" not in kinds["sets"] and kinds["shared"] == ["long", "long"]


@pytest.mark.parametrize("large", [True, False])
def test_a_star_reads_its_links_twice(spark, large):
    plan = C._star(spark.createDataFrame([(1, 2)], "a long, b long"), large)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Union" not in plan


@pytest.mark.parametrize("few", [50_000, 0])
def test_components_are_those_of_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)] + [(5, None), (7, 7), (119, 100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = [tuple(x) for x in C.components(spark.createDataFrame(links, "a long, b long")).select("node", "component").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in list(root))
