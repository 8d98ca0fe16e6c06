"""Top-k retrieval for many questions against plain loops."""

import random

import pytest

from clipworks.functions import sparse
from clipworks.operators import retrieval


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(60)]
    offers = {}
    for kind in ("a", "b"):
        for n in range(300 if kind == "a" else 7):
            for f in {x for x in common if rng.random() < 0.8} | set(rng.sample(rare, rng.randrange(3))):
                offers[kind, f"{kind}{n:03}", f] = rng.choice([1, 1, 2, 3, 5])
        offers[kind, f"{kind}004", "f:once"] = 1
    wanted, constants = {}, {}
    for q in range(40):
        for kind in ("a", "b"):
            words = set(rng.sample(common, rng.randrange(5))) | set(rng.sample(rare, rng.randrange(4)))
            for f in words:
                wanted[q, kind, f] = (True, rng.choice([1, 2, 3, 8]))
            if rng.random() < 0.4:
                wanted[q, kind, "f:once"] = (False, rng.choice([-3, 20]))
            if rng.random() < 0.3:
                wanted[q, kind, "c1"] = (False, 4)
            constants[q, kind] = (rng.choice([0, 0, 2]), rng.choice([0, 5]))
    return wanted, offers, constants


def best(wanted, offers, constants, limits):
    out = set()
    items = {(kind, item) for kind, item, _ in offers}
    for (q, kind), (const, bias) in constants.items():
        rows = []
        for item in [i for k, i in items if k == kind]:
            met = [(main, w * offers[kind, item, f]) for (p, k, f), (main, w) in wanted.items() if p == q and k == kind and (kind, item, f) in offers]
            base, boost = const + sum(v for main, v in met if main), sum(v for main, v in met if not main)
            score = base + boost + (bias if base > 0 else 0)
            if score > 0:
                rows.append((-score, item, base, boost))
        out |= {(q, kind, item, base, boost, -s, r) for r, (s, item, base, boost) in enumerate(sorted(rows)[:limits[kind]], 1)}
    return out


@pytest.mark.parametrize("champions", [1, 8])
def test_best_matches_are_exact(spark, model, champions):
    wanted, offers, constants = model
    limits = {"a": 5, "b": 3}
    w = spark.createDataFrame([(*k, *v) for k, v in wanted.items()], "key long, kind string, feature string, main boolean, weight long")
    o = spark.createDataFrame([(*k, v) for k, v in offers.items()], "kind string, item string, feature string, strength long")
    c = spark.createDataFrame([(*k, *v) for k, v in constants.items()], "key long, kind string, base long, bias long")
    first = spark.createDataFrame([(kind, f"{kind}{n:03}") for kind in ("a", "b") for n in range(5)], "kind string, item string").join(o.select("kind", "item").distinct(), ["kind", "item"], "left_semi")
    got = sparse.best_matches(w, o, limits, c, first, champions=champions)
    assert {tuple(r) for r in got.collect()} == best(wanted, offers, constants, limits)


def test_postings_are_all_places_of_all_values(spark):
    rng = random.Random(6)
    texts = [("k", str(i % 90), i // 90, i // 90 + 1, "".join(rng.choice("abcé 中") for _ in range(rng.randrange(60)))) for i in range(270)]
    texts = [t for t in texts if t[4]] + [("k", "long", 0, 2, "ab" * 20_000 + "xyz")]
    values = {"".join(rng.choice("abcé 中") for _ in range(rng.randrange(1, 7))) for _ in range(300)} | {"xyz", "bx", "ab" * 500, "nowhere at all"}
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "value string")
    got = retrieval.postings(spark.createDataFrame(texts, "kind string, item string, field int, strength int, text string"), df)
    want = {}
    for kind, item, _, strength, text in texts:
        for v in values:
            if len(v) >= 2 and v in text:
                want[kind, item, v] = want.get((kind, item, v), 0) + strength
    assert {(r.kind, r.item, r.value): r.strength for r in got.collect()} == want


def test_page_texts_follow_the_turns(spark):
    turns = spark.createDataFrame([(1, "old words", 2), (1, "newest", 1), (2, "only", 1)], "conv_id long, text string, from_end int")
    contexts = spark.createDataFrame([(1, "", "anan", None, "src5"), (2, None, "", "", ""), (3, "erin", "", "", "")], "conv_id long, query string, region string, category string, source string")
    got = {(r.conv_id, r.value): r.weight for r in retrieval.extract_signals(turns, page=retrieval.page_texts(contexts)).collect()}
    assert got[1, "src5"] == 5 and got[1, "newest"] == 4 and got[1, "anan"] == 3 and got[2, "only"] == 5 and got[3, "erin"] == 5


def test_edge_evidence_by_bitmaps_equals_loops(spark, monkeypatch):
    import datetime

    from clipworks.operators import graph

    monkeypatch.setattr(graph, "BUCKET", 8)  # many runs of articles
    rng = random.Random(8)
    names = ["hub", "alpha", "beta", "gamma", "delta"]
    arts = [(i, " ".join(rng.sample([*names, "glue", "tie", "other"], rng.randrange(5))), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(20))) for i in range(150)]
    edges = [("hub", n, ["glue", "tie"] if n != "beta" else []) for n in names[1:]] + [("alpha", "beta", ["glue"])]
    empty = "array<string>"
    articles = spark.createDataFrame([(i, t, "", [], "s", [], d) for i, t, d in arts], f"id long, title string, summary string, keywords {empty}, source string, region_tags {empty}, published_at timestamp_ntz")
    nodes = spark.createDataFrame([(n, n, []) for n in names], f"id string, name string, aliases {empty}")
    got = {tuple(r) for r in graph.edge_evidence(spark.createDataFrame(edges, f"source_id string, target_id string, keywords {empty}"), nodes, articles, 6).collect()}
    want = set()
    for s, t, words in edges:
        hits = [(-d.timestamp(), i) for i, text, d in arts if ((s in text.split()) + (t in text.split()) + any(w in text.split() for w in words)) >= 2]
        want |= {(s, t, i, r) for r, (_, i) in enumerate(sorted(hits)[:6], 1)}
    assert got == want and len(want) > 20
