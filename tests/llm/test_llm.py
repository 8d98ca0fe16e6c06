"""The corpus operators against brute force, and their defined results for odd inputs."""

import collections
import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipworks.llm import ann, components, embedding_dedup, line_dedup, lm, minhash, mixing, pieces, quality, queries, secrets, toxicity
from clipworks.llm import textbytes as tb
from clipworks.llm.frames import read

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, copy int, made string, u long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7, 1, "x", 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "éta", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one two", "b"), (None, "one two", "b"), (None, None, None)]
    rows += [(10 + k, b, "a") for k, b in enumerate(base)] + [(20 + k, b.upper(), "a") for k, b in enumerate(base)]
    for k in range(30):
        edited = base[k % 4].split()
        for _ in range(k // 4):
            edited[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((40 + k, " ".join(edited), "c"))
    rows += [(90, base[0], "a"), (90, base[0], "a"), (91, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "d")]
    return frame(spark, rows).cache()


def empty(spark):
    return frame(spark, [(1, "x", "a")]).where("false")


def classes(sets, percent=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text, width):
    w = words(text)
    return set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())


# --- 9 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(spark, odd, width):
    sets = {r.doc_id: shingle_set(r.text, width) for r in odd.collect() if r.doc_id is not None}
    want = classes(sets)
    got = minhash.near_duplicates(odd, width=width).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), want[r.id], r.id == want[r.id])
    nameless = [r for r in got if r.id is None]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in nameless if r.n_shingles) == [(1, 6, False)] and sum(r.kept for r in nameless) == 1


def test_minhash_stage_keeps_one_of_each(spark, odd):
    out = minhash.drop_near_duplicates(odd, width=5)
    assert out.columns == odd.columns
    kept = {r.doc_id for r in out.collect() if r.doc_id is not None}
    sets = {r.doc_id: shingle_set(r.text, 5) for r in odd.collect() if r.doc_id is not None}
    assert kept == {i for i, c in classes(sets).items() if i == c}
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.drop_near_duplicates(empty(spark)).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    k, bits = minhash.FINE_SAMPLES, 64 * minhash.FINE_WORDS
    a = rng.integers(0, 1 << 60, (k, 1), dtype=np.uint64)
    b = np.where(np.arange(k)[:, None] < 0.85 * k, a, rng.integers(0, 1 << 60, (k, 1), dtype=np.uint64))
    x = minhash.parities(a, minhash.FINE_WORDS) ^ minhash.parities(b, minhash.FINE_WORDS)
    odd_bits = int(np.bitwise_count(x).sum())
    assert abs(1 + bits * math.log(1 - 2 * odd_bits / bits) / (4 * k) - 0.85) < minhash.FINE_SLACK


def test_components_follow_chains(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 100), (7, 7), (101, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 100: 50, 101: 50}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------
def chunked(text):
    data, offsets = tb.flat(pa.array([text]))
    _, _, _, last, _ = line_dedup.cut(data, offsets, line_dedup.WINDOW, line_dedup.DIVISOR)
    lines, out, at = text.split("\n"), [], 0
    for e in last:
        out.append("\n".join(lines[at:e]))
        at = e
    assert at == len(lines)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    passage = "\n".join(f"shared line {k} {rng.random()}" for k in range(12))
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(6))] + [passage] + [f"tail {k}"]), "a") for k in range(8)]
    rows += [(20, passage, "a"), (21, passage, "a"), (22, None, "a"), (23, "", "a"), (24, "\n\n", None), (None, passage, "a"), (30, rows[0][1], "a"), (30, rows[0][1], "a"), (31, "x\r\ny\n" * 2000, "a")]
    first = {}
    for i, t, _ in sorted({(i, t, s) for i, t, s in rows if i is not None and t is not None}):
        for k, c in enumerate(chunked(t)):
            if sum(1 for x in c.split("\n") if x.strip(" \t\r\x0b\x0c")) >= 2:
                first.setdefault(c, (i, k))
    want = collections.Counter()
    for i, t, _ in rows:
        want[i, t if not t or i is None else "\n".join(c for k, c in enumerate(chunked(t)) if first.get(c, (i, k)) == (i, k))] += 1
    out = line_dedup.dedup_lines(frame(spark, rows), drop_emptied=False)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
    kept = collections.Counter(r.doc_id for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    texts = collections.Counter(i for i, t, _ in rows)
    emptied = {i for (i, t) in want if t == "" and i != 23}
    assert kept == collections.Counter({i: n for i, n in texts.items() if i not in emptied})
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def repeated_runs(texts):
    """For each id the lines that a run of two or more lines that aren't blank covers and that stand alike earlier."""
    lines = [(i, n, x) for i, t in sorted(texts.items()) for n, x in enumerate(t.split("\n"))]
    gone = collections.defaultdict(set)
    for shift in range(1, len(lines)):
        run = []
        for k in range(shift, len(lines) + 1):
            if k < len(lines) and lines[k][2] == lines[k - shift][2] and (not run or (lines[k][0] == lines[k - 1][0] and lines[k - shift][0] == lines[k - 1 - shift][0])):
                run.append(k)
                continue
            full = [j for j in run if lines[j][2].strip(" \t\r\x0b\x0c")]
            if len(full) >= 2:
                for j in range(full[0], full[-1] + 1):
                    gone[lines[j][0]].add(lines[j][1])
            run = [k] if k < len(lines) and lines[k][2] == lines[k - shift][2] else []
    return gone


def test_repeated_runs_go_whole(spark):
    rng = random.Random(5)
    pools = [[f"passage {p} line {k}" + (" " * (k % 3 == 2)) if k % 4 != 3 else " \t" * (p % 2) for k in range(n)] for p, n in enumerate([2, 3, 4, 5, 8, 12])]
    texts = {}
    for i in range(40):
        parts = [[f"own {i} {j}" for j in range(rng.randrange(4))]]
        for _ in range(rng.randrange(4)):
            pool = rng.choice(pools)
            lo = rng.randrange(len(pool))
            parts += [pool[lo:rng.randrange(lo, len(pool)) + 1], [f"between {i} {rng.random()}"] * rng.randrange(3), [""] * rng.randrange(2)]
        texts[i] = "\n".join(x for p in parts for x in p)
    texts |= {50: "\n".join(pools[5]), 51: "\n\n" + "\n".join(pools[5]) + "\n \n", 52: "a\na\na\nb\na\nb", 53: "x\r\ny\r\n" * 40, 54: "\n\n"}
    gone, want = repeated_runs(texts), {}
    for i, t in texts.items():
        kept = [x for n, x in enumerate(t.split("\n")) if n not in gone[i]]
        want[i] = t if not gone[i] else "\n".join(kept if any(x.strip() for x in kept) else [])
    rows = [(i, t, "a") for i, t in texts.items()] + [(60, None, "a"), (61, "", "a"), (None, texts[50], "a"), (50, texts[50], "a")]
    out = line_dedup.dedup_runs(frame(spark, rows), drop_emptied=False).collect()
    assert len(out) == len(rows) and {r.doc_id: r.text for r in out if r.doc_id in want} == want
    assert all(r.text == t for r in out for i, t in [(60, None), (61, ""), (None, texts[50])] if r.doc_id == i)
    assert sum(bool(g) for g in gone.values()) > 10 and want[51] == "" and want[52] == "a\nb"
    kept = {r.doc_id for r in line_dedup.dedup_runs(frame(spark, rows)).collect()}
    assert kept == {None, 60, 61} | {i for i in texts if want[i] or not texts[i]}
    assert line_dedup.dedup_runs(empty(spark)).count() == 0


def test_query_and_stage_remove_whole_runs(spark, tmp_path):
    passage = "\n".join(f"shared {k}" for k in range(4))
    frame(spark, [(k, f"before {k}\n{passage}\nafter {k}", "a") for k in range(6)]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = read(spark, str(tmp_path), "documents")
    want = {k: f"before {k}\n" + (f"{passage}\n" if k == 0 else "") + f"after {k}" for k in range(6)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == want
    out = queries.op10(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.removed_lines, r.kept_chars) for r in out} == {k: (4 * (k > 0), len(t)) for k, t in want.items()}


def test_runs_meet_in_content_defined_chunks():
    """Every passage lies in one chunk, and boundaries inside a passage come out alike after any insertion before it."""
    def chunks(text):
        rows = pa.Table.from_batches(line_dedup.passage_rows()([pa.record_batch([pa.array([7]), pa.array([text])], ["id", "text"])])).to_pylist()
        assert [r["no"] for r in rows] == list(range(text.count("\n")))
        assert all(r["chunk_no"] <= r["no"] < r["last"] <= r["chunk_last"] for r in rows)
        spans = sorted({(r["chunk_no"], r["chunk_last"]) for r in rows})
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # the boundary line is in both
        return {r["chunk_h"]: "\n".join(text.split("\n")[r["chunk_no"]:r["chunk_last"] + 1]) for r in rows}

    lines = [f"line {k * k}" for k in range(60)]
    whole, moved = chunks("\n".join(lines)), chunks("\n".join(["new", "newer", *lines[5:]]))
    shared = whole.keys() & moved.keys()
    assert len(shared) >= 5 and all(whole[h] == moved[h] for h in shared)
    assert max(t.count("\n") for t in whole.values()) > 1


def test_runs_are_compared_by_bytes(spark):
    def thue_morse(k, a="a", b="b"):
        return a if k == 0 else thue_morse(k - 1, a, b) + thue_morse(k - 1, b, a)

    one, other = thue_morse(12), thue_morse(12, "b", "a")
    h = line_dedup.digests(*tb.flat(pa.array([one + other]))[:1], np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] == h[1]  # no hash of running sums tells these apart
    texts = {1: f"x\n{one}\ny", 2: f"x\n{other}\ny", 3: f"0\nx\n{other}\ny\n1", 4: f"{one}\ny"}
    got = {r.doc_id: r.text for r in line_dedup.dedup_runs(frame(spark, [(i, t, "a") for i, t in texts.items()]), drop_emptied=False).collect()}
    assert got == {1: texts[1], 2: texts[2], 3: "0\n1", 4: ""}
    rng = random.Random(8)
    texts = {i: "\n".join(rng.choice("abcdefghijkl") * rng.randrange(1, 4) for _ in range(12)) for i in range(30)}
    gone = repeated_runs(texts)
    got = line_dedup.dedup_runs(frame(spark, [(i, t, "a") for i, t in texts.items()]), drop_emptied=False, size=1).collect()
    assert {r.doc_id: r.text for r in got} == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}


# --- 6 ---------------------------------------------------------------------------------------------------------------
def test_mixing_reaches_target_weights(spark):
    docs = frame(spark, [(k, f"t{k}", ["big", "small", None][(k % 10 > 6) + (k % 10 > 8)]) for k in range(3000)])
    got = collections.Counter(r.source for r in mixing.mix_sources(docs, weights={"big": 1.0, "small": 3.0}).collect())
    assert got[None] == 0 and abs(got["small"] / 2250 - 1) < 0.1 and abs(got["big"] / 750 - 1) < 0.12
    out = mixing.mix_sources(docs)
    again = mixing.mix_sources(docs.repartition(7))
    assert collections.Counter(map(tuple, out.select("doc_id", "copy_").collect())) == collections.Counter(map(tuple, again.select("doc_id", "copy_").collect()))
    assert set(docs.columns) <= set(out.columns) and mixing.mix_sources(empty(spark)).count() == 0
    many = mixing.mix_sources(frame(spark, [(1, "x", "a"), (2, None, "a"), (None, None, "a")]), epochs=1500.0)
    assert abs(many.count() / 4500 - 1) < 0.1  # rates above the limit are split


# --- 3 ---------------------------------------------------------------------------------------------------------------
def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    vocabulary = np.arange(1, 200, dtype=np.uint64)
    rows = [(i, int(rng.integers(2)), rng.choice(vocabulary, 12, replace=False).view(np.int64), rng.integers(1, 4, 12)) for i in range(500)]
    index = toxicity.build(rows, vocabulary, rng.random(len(vocabulary)) + 0.5, (300, 200))
    dense = np.zeros((len(rows), len(vocabulary)))
    for i in range(len(rows)):
        for t in range(len(vocabulary)):
            slot = index.slot[t, i // toxicity.BLOCK]
            dense[i, t] = index.weights[slot, i % toxicity.BLOCK] if slot >= 0 else 0
    assert np.allclose((dense ** 2).sum(axis=1), 1)
    for _ in range(50):
        at, q = index.vector(np.sort(rng.choice(vocabulary, 9, replace=False)), rng.integers(1, 3, 9))
        s = dense[:, at] @ q
        pos, cos = index.nearest(at, q, 15)
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:15]
        assert np.allclose(cos, s[want]) and np.allclose(s[pos], cos)


def test_toxicity(spark, odd):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    index = toxicity.fit(docs, labels, keep=~toxicity.held_out())
    rows = toxicity.score_texts(docs, index).join(labels, "doc_id").where(toxicity.held_out()).select("toxicity.score", "toxic").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) >= 0.88 * len(rows)
    out = toxicity.score_texts(odd, index).collect()
    assert len(out) == odd.count() and all(0 <= r.toxicity.score <= 1 for r in out)
    none = toxicity.fit(odd, labels.where("false"))
    assert {r.toxicity.score for r in toxicity.score_texts(odd, none).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels.where("false")).columns == odd.columns
    assert toxicity.score_texts(empty(spark), index).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------
def test_quality(spark, odd):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    measured = quality.measure(docs)
    fitted = quality.fit(measured, labels, keep=~quality.held_out())
    rows = quality.score(measured, fitted).join(labels, F.col("id") == F.col("doc_id")).where(quality.held_out()).select("quality_score", "quality").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    texts = [r.text or "" for r in docs.limit(50).collect()]
    for k, v in zip(texts, quality.statistics(pa.array(texts))):
        assert math.isclose(v[0], math.log1p(len(WORD.findall(k)))) and math.isclose(v[10], math.log1p(len(WORD.findall(k)) / (k.count("\n") + 1)))
    strange = quality.measure(odd)
    assert all(0 <= r.quality_score <= 1 for r in quality.score(strange, fitted).collect()) and strange.count() == odd.count()
    for few in (labels.where("false"), labels.where("quality = 1")):
        assert all(0 <= r.quality_score <= 1 for r in quality.score(strange, quality.fit(measured, few)).collect())
    assert quality.score(quality.measure(empty(spark)), fitted).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------
def test_lm(spark, odd):
    learnt = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 != 1
    rows = odd.select("doc_id", "text").collect()
    count = collections.Counter(w for r in rows if learnt(r.doc_id) for w in [*words(r.text), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in rows:
        w = [*words(r.text), None]
        want[r.doc_id, learnt(r.doc_id), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    got = lm.score_texts(odd, keep=~lm.held_out()).collect()
    assert collections.Counter((r.id, r.learnt, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(empty(spark)).count() == 0


def test_lm_scores_each_token_once_with_proper_probabilities():
    start, end, scored, _ = lm.windows(np.array([0, 5, 5, 40, 400]))
    seen = np.zeros(400, int)
    for a, b in zip(scored, end):
        seen[a:b] += 1
    assert (seen == 1).all() and (end - start).max() <= lm.WINDOW
    rng = np.random.default_rng(0)
    model = lm.Attention(rng.integers(0, 9, 300).astype(float))
    ids = rng.integers(0, 300, 12)
    total = 0.0
    for t in range(300):
        total += math.exp(model.token_logs(np.append(ids, t), np.array([0, 13]))[-1])
    assert abs(total - 1) < 1e-3
    longer = model.token_logs(np.append(ids, [5, 6, 7]), np.array([0, 15]))
    assert np.allclose(longer[:12], model.token_logs(ids, np.array([0, 12])), atol=1e-4)  # causal


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", 8000)
    texts = [f"alpha beta {'zeta eta' if i % 40 == 0 else 'gamma'} {i}" for i in range(1500)]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(9000, None, "a"), (9001, "left out", "a")])
    model = pickle.loads(lm.train_model(docs, "doc_id", "text", F.col("doc_id") != 9001, pieces.MODEL))
    data, offsets = tb.flat(pa.array(texts))
    ids = lm.tokens(data, offsets, pieces.MODEL)[2]
    assert model.learnt == len(ids)  # over several shards and rounds, each token once
    counts = np.bincount(ids, minlength=len(model.slot))
    assert np.array_equal(model.slot, lm.Attention(counts.astype(float)).slot)
    assert np.isfinite(model.flat()).all() and not np.allclose(model.flat(), lm.Attention(counts.astype(float)).flat())


# --- 1 ---------------------------------------------------------------------------------------------------------------
def test_pieces(spark, odd):
    machine = pieces.automaton()
    table = {p: (machine.vocabulary.scores[i], i) for i, p in reversed(list(enumerate(machine.vocabulary.pieces))) if p}

    def viterbi(text):
        data = b" " + text.encode() if text else b""
        best = [(0, None, None)]
        for e in range(1, len(data) + 1):
            top = (best[e - 1][0] + machine.worst, machine.vocabulary.byte_ids[data[e - 1]], 1)
            for k in range(min(e, 80), 0, -1):
                hit = table.get(data[e - k:e])
                if hit and best[e - k][0] + hit[0] > top[0]:
                    top = (best[e - k][0] + hit[0], hit[1], k)
            best.append(top)
        out, e = [], len(data)
        while e:
            out.append(best[e][1])
            e -= best[e][2]
        return out[::-1]

    texts = ["", " ", "  a  b", "\n\n x\t", "a▁b ▁▁ c", "中文𓀀 é", "x" * 500, " ▁", "Hello\x00 world"] + [r.text[:1500] for r in odd.collect() if r.text]
    ids = pieces.encode(pa.array(texts))
    assert ids.to_pylist() == [viterbi(t) for t in texts]
    assert pieces.decode(ids).to_pylist() == texts
    out = pieces.encode_texts(odd).withColumn("back", pieces.decode_column(F.col("piece_ids"))).collect()
    assert all((r.text or "") == r.back and bool(r.piece_ids) == bool(r.text) for r in out)
    assert pieces.decode(pa.array([None, [], [3 + 0xC3]], pa.list_(pa.int32()))).to_pylist() == [None, "", "�"]
    assert pieces.encode_texts(empty(spark)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------
def test_secrets(spark, odd):
    rng = random.Random(1)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16))
    rows = [(k, f"the other word {key()} follows here" if k % 2 else f"write to some.name{k}@mail{k}.example.com today", "a") for k in range(60)]
    rows += [(100, None, "a"), (None, f"with {key()}", "a"), (101, f"with {key()}", "a"), (101, f"with {key()}", "a"), (102, "", None)]
    found = secrets.scan(frame(spark, rows))
    got = found.collect()
    assert len(got) == 63 and all(r.is_secret == r.value.startswith("AKIA") for r in got)
    assert not [c for c in ("Python", "Arrow", "Pandas") if c in found._jdf.queryExecution().toString()]
    assert secrets.scan(empty(spark)).count() == 0
    assert {r.score for r in secrets.scan(frame(spark, rows[:1])).collect()} == {1.0}


# --- 7, 8 ------------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, id long, s double, v int"


def vectors(spark, extra=()):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    rows = [(k, (centre[k % 6] + rng.standard_normal(16) * (0.12 if k % 3 else 0.6)).tolist(), k % 2) for k in range(300)]
    rows += [(400 + k, rows[k % 2][1], 0) for k in range(40)] + list(extra)
    return spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], VECTORS), rows


BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0] * 16, None), (906, [], 0), (None, [1.0] * 16, 1)]


def test_embedding_dedup_of_doubles_of_any_size(spark):
    rows = [(1, [1e-60, 0.0]), (2, [2e-60, 0.0]), (3, [0.0, 1e200]), (4, [1e150, 2e200]), (5, [5e-324, -1e-323]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0]), (8, [1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (0, 7), 8: (1, 5)}


def test_embedding_dedup_equals_brute_force(spark):
    df, rows = vectors(spark, BAD + [(0, [1.0] * 16, 1), (0, [1.0] * 16, 1)])
    first = {}
    for i, v, label in rows:
        if i is not None and (i not in first or (label, v) < first[i]):
            first[i] = (label, v)
    good = {i: (label, np.array(v, np.float32).astype(float)) for i, (label, v) in first.items() if i < 900}
    ids = sorted(good)
    unit = np.array([good[i][1] / np.linalg.norm(good[i][1]) for i in ids])
    label = np.array([good[i][0] for i in ids])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = classes({i: {("own", i)} | {frozenset((i, ids[b])) for b in np.flatnonzero(linked[a])} for a, i in enumerate(ids)}, 1e-9)
    got = embedding_dedup.near_duplicates(df, block=64).collect()
    assert len(got) == len(first) + 1
    n = dict(zip(ids, linked.sum(axis=1)))
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == ((n[r.id], want[r.id], want[r.id] == r.id) if r.id in n else (0, r.id, True))
    assert sum(n.values()) > 500 and embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * rng.standard_normal((200, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]) @ embedding_dedup.rotation(64).T
    code, factor = embedding_dedup.encode(x)
    signs = np.where(x > 0, 1, -1) / 8
    assert abs(np.mean((x @ signs.T) / factor[None, :] - x @ x.T)) < 0.005
    marked = embedding_dedup.candidates(*embedding_dedup.planes(x), code, factor, 0.93, 64)
    assert not ((x @ x.T >= 0.93) & ~marked).any() and marked.mean() < 0.05


def test_nearest_neighbours(spark):
    df, rows = vectors(spark, BAD + [(7, [9.0] * 16, 1)])
    good = {}
    for i, v, _ in rows:
        if i is not None and i < 900 or i == 905:
            good[i] = min(good.get(i, v), v, key=lambda x: [np.float32(y) for y in x])
    ids = np.array(sorted(good))
    x = np.array([np.array(good[i], np.float32).astype(float) for i in ids])
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    recall = []
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - s[np.flatnonzero(ids == f[1])[0]]) < 1e-9 for f in found)
        recall.append(len({f[1] for f in found} & set(ids[order].tolist())) / 20)
    assert np.mean(recall) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("outlier", [1.0, 100.0])
def test_nearest_neighbours_of_unequal_norms(spark, outlier):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.7 * rng.standard_normal((3000, 64))
    x *= (np.exp(rng.uniform(np.log(0.5), np.log(2), 3000)) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= outlier
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 60 == 0).collect():
        got[r.query_id].add(r.id)
    assert set(got) == set(range(0, 3000, 60))
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(found & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, odd, tmp_path):
    columns = odd.columns
    for docs in (odd, empty(spark), read(spark, FOLDER, "documents")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == columns, name
            out.write.parquet(str(tmp_path / f"{name}-{id(docs)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{id(docs)}"))
        last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert last.count() == docs.count()
        assert pieces.decode(pa.array([r.piece_ids for r in last.collect()], pa.list_(pa.int32()))).to_pylist() == [r.text or "" for r in last.collect()]


def test_pipeline_drops_toxic_and_copies(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    clean = corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.01")
    gone = docs.join(clean.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 0.02 * labels.count()
    near = {r.doc_id: shingle_set(r.text, 5) for r in corpus_pipeline.near_stage(spark, docs, FOLDER).collect()}
    assert set(near) == {i for i, c in classes({r.doc_id: shingle_set(r.text, 5) for r in docs.collect()}).items() if i == c}


def test_words_and_hashes():
    texts = ["A bB\tcc\x0bc", None, "", " x ", "é É"]
    got = []
    for hashes, first in tb.word_hashes(pa.array(texts)):
        got += [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(g) for g in got] == [4, 0, 0, 1, 2] and got[0][0] != got[0][1] and got[4][0] != got[4][1]
    again = [h for hashes, _ in tb.word_hashes(pa.array(["zz x", "bb"])) for h in hashes.tolist()]
    assert again[1] == got[3][0] and again[2] == got[0][1]


def test_the_rest_imports_without_the_corpus_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for name, left_out in (("a", ("llm",)), ("b", ("llm", "corpus_pipeline.py"))):
        copy = shutil.copytree(root, tmp_path / name, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


def test_scores_without_fresh_memory_are_those_of_the_layers():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.4, 5000) % 700
    first = np.array([0, 1, 1, 30, 62, 63, 900, 5000])
    model = lm.Attention(np.bincount(ids, minlength=700).astype(float)).train(ids, first, steps=15)
    got = model.token_logs(ids, first, batch=7)
    start, end, scored, row_start = lm.windows(first)
    for w in range(len(start)):
        at, there, before = model.padded(ids, start[w:w + 1], end[w:w + 1], row_start[w:w + 1])
        size = end[w] - start[w]
        before, here = before[:, :size], ids[at[:, :size]]
        logits, sums, (x, *_, y, _, _) = model.forward(before)
        found, gate, _ = model.point(x, y, here)
        own = np.exp(logits[np.arange(size), model.slot[here[0]]] - sums + model.rest[here[0]])
        want = np.log(np.maximum((1 - gate[0]) * own + gate[0] * found[0], 1e-30))
        new = slice(scored[w] - start[w], size)
        assert np.allclose(got[scored[w]:end[w]], want[new], atol=1e-4)


def test_words_solved_together_are_those_solved_alone():
    machine, rng = pieces.automaton(), random.Random(9)
    words = [(" " * rng.randrange(3) + "".join(rng.choice("etaoin srhlé中\U0001F600xyz") for _ in range(rng.randrange(30)))).encode() for _ in range(3000)]
    words += [b"", b"a" * 511, b"a" * 512, b"a" * 513, b"the" * 400, b" " * 70, bytes(range(1, 128))]
    rng.shuffle(words)
    size = np.array([len(w) for w in words])
    ids, n = machine.encode_many(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, np.cumsum(size))
    want = [machine.encode(w) for w in words]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in machine.encode_many(np.zeros(0, np.uint8), none, none)] == [0, 0]


def test_rare_tokens_are_told_apart_as_context():
    """all tokens but the 127 commonest were one symbol to the attention model."""
    rng = np.random.default_rng(6)
    a, b, texts = 500, 501, []
    for n in range(1500):
        rare = (a, 1) if n % 2 else (b, 2)
        texts.append(np.concatenate([rng.integers(0, 130, 8), rare, rng.integers(0, 130, 8), rare[:1] if n % 50 == 0 else []]))
    ids = np.concatenate(texts).astype(np.int64)
    first = np.cumsum([0] + [len(t) for t in texts])
    counts = np.bincount(ids, minlength=600).astype(float)
    counts[:130] += 1000  # a and b are not among the commonest
    model = lm.Attention(counts).train(ids, first, steps=250)
    assert model.slot[a] == model.slot[b] == lm.CLASSES - 1
    logs = {(x, y): model.token_logs(np.array([7, 8, x, y]), np.array([0, 4]))[-1] for x in (a, b) for y in (1, 2)}
    assert logs[a, 1] > logs[b, 1] + 0.7 and logs[b, 2] > logs[a, 2] + 0.7
    unseen = model.token_logs(np.array([7, 8, 590, 1]), np.array([0, 4]))
    assert np.isfinite(unseen).all()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.4, 900) % 400
    first = np.array([0, 5, 40, 300, 900])
    model = lm.Attention(np.bincount(ids, minlength=410).astype(float)).train(ids, first, steps=5)
    start, end, _, row_start = lm.windows(first, lm.WINDOW, lm.WINDOW)
    at, there, before = model.padded(ids, start[:9], end[:9], row_start[:9])
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    loss = lambda: model.gradients(before, ids[at], there.astype(np.float64))
    logits, sums, (x, *_, y, _, _) = model.forward(before)
    found, gate, _ = model.point(x, y, ids[at])
    own = np.exp(logits[np.arange(before.size), model.slot[ids[at]].ravel()] - sums + model.rest[ids[at]].ravel()).reshape(before.shape)
    value, grads, (rows, of_rows) = loss()
    assert abs(value + (np.log((1 - gate) * own + gate * found) * there).sum() / there.sum()) < 1e-4
    grads["own"] = np.zeros_like(model.w["own"])
    grads["own"][rows] = of_rows
    assert grads.keys() == model.w.keys()
    for k, w in model.w.items():
        place = rng.integers(0, w.size, 4)
        for i in place if k != "own" else place % 160:
            flat, e = w.reshape(-1), 1e-4
            kept = flat[i]
            flat[i] = kept + e
            up = loss()[0]
            flat[i] = kept - e
            down = loss()[0]
            flat[i] = kept
            assert abs((up - down) / (2 * e) - grads[k].reshape(-1)[i]) < 1e-4 + 0.01 * abs(grads[k].reshape(-1)[i])
