"""URL filters, cross-tokenizer alignment and spelling variants against brute force, and their defined results for odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipworks.llm import alignment, frames, spelling, url_filter
from clipworks.llm.frames import read

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, n long, block long, pair string, id long, a int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows):
    """Rows (doc_id, text) with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y", 3, 4) for i, t in rows], DOCS)


# --- 11 --------------------------------------------------------------------------------------------------------------
def links(*hosts):
    return "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)


PAGES = [
    (1, "http://Good.com/a/1", links("a.org", "B.org") + "<img SRC='//c.org/i'>"), (2, "https://bad.net/spam/1", links("a.org")), (3, "http://a.org/x", links("b.org")),
    (4, "http://b.org/", None), (5, "http://c.org?x=1", links("bad.net", "bad.net")), (6, "http://d.org/#q", links("c.org")), (7, None, links("a.org")), (8, "", ""),
    (None, "nothing here", ""), (9, "http://sub.bad.net/spam", ""), (9, "http://sub.bad.net/spam", ""), (10, "http://good.com", "<a href=/rel>"),
    (11, "http://x.good.com/a/deny/z", ""), (12, "http://" + "a." * 3000 + "good.com/" + "p/" * 3000, "x" * 100_000 + links("d.org")), (13, "http://notgood.com/a", ""), (14, "http://e.org/", links("bad.net")),
]
RULES = [("good.com", "/", "allow"), ("bad.net", "/spam", "block"), ("good.com", "/a/de", "block"), ("good.com", "/a/de", "allow"), ("b.org", "", "allow")]


def judged(rows, rules, rounds=40):
    """(id, host, path, rule, verdict, trust, distrust) by plain loops; ``rules`` as in RULES, of equal ones block holds."""
    parts, shares, edges = [], collections.defaultdict(list), collections.Counter()
    for i, url, html in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        parts.append((i, host, path, rule))
        if rule and host:
            shares[host].append(rule[2])
        for to in {lower(x) for x in re.findall(r"(?:href|src)=[\"']?(?:http:)?//([^/\"'>]+)", (html or "").replace("SRC", "src"))}:
            if host and to != host:
                edges[host, to] += 1

    def rank(seed, edges):
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        x = {h: 0.15 * s for h, s in seed.items() if s}
        total = collections.Counter(x)
        for _ in range(rounds):
            y = collections.Counter()
            for (a, b), n in edges.items():
                if x.get(a, 0) >= 1e-6:
                    y[b] += 0.85 * x[a] * n / out[a]
            total.update(y)
            x = y
        return total

    trust = rank({h: v.count("allow") / len(v) for h, v in shares.items()}, edges)
    distrust = rank({h: v.count("block") / len(v) for h, v in shares.items()}, {(b, a): n for (a, b), n in edges.items()})
    return collections.Counter((i, host, path, r[0] + r[1] if r else None, r[2] if r else "block" if distrust[host] > trust[host] else "allow", round(trust[host], 6), round(distrust[host], 6)) for i, host, path, r in parts)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "h", 1, 2.0) for r in PAGES], "page_id long, url string, html string, host string, _salt int, trust double")


def got_pages(df):
    return collections.Counter((*r[:5], round(r.trust, 6), round(r.distrust, 6)) for r in df.collect())


def test_url_rules_and_host_trust(spark, pages):
    want = judged(PAGES, RULES)
    verdicts = {r[1]: r[4] for r in want if r[3] is None}
    assert verdicts["e.org"] == "block" and verdicts["a.org"] == "allow"
    assert got_pages(url_filter.judge(pages, RULES)) == want
    assert got_pages(url_filter.judge(pages, spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string"))) == want


def test_hot_hosts_are_dealt_out(spark, pages, monkeypatch):
    monkeypatch.setattr(frames, "HOT_ROWS", 1)
    assert got_pages(url_filter.judge(pages, RULES)) == judged(PAGES, RULES)


def test_urls_without_rules_or_rows(spark, pages):
    none = url_filter.judge(pages, [])
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")} and none.count() == len(PAGES)
    assert url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule IS NOT NULL OR verdict <> 'allow'").isEmpty()
    assert url_filter.judge(pages.where("false"), RULES).isEmpty()


def test_hot_keys_are_few(spark):
    counts = spark.range(5000).select(F.col("id").alias("k"), F.lit(20_000).alias("n")).union(spark.createDataFrame([(-1, 9_000_000)], "k long, n int"))
    assert [r.k for r in frames.hot_keys(counts, ["k"], "n").collect()] == [-1]


# --- 12 --------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    letters = "ab \n\t  　é’<s>▁ \x1c\x85 1's"
    odd = [(10**6 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for k in range(1500)]
    odd += [(1, None), (2, ""), (3, " "), (None, "  a  "), (None, None), (5, "x" * 5000), (6, "<|endoftext|> hi <s> <0x0A> \x00"), (7, "one two three"), (7, "one two three"), (8, " ".join(rng.choice(["alpha", "béta", "gamma,"]) for _ in range(40_000)))]
    given = [(r.doc_id, r.text) for r in read(spark, FOLDER, "documents").collect()]
    return frame(spark, given + odd).repartition(5), given + odd


def spelt(text):
    """(ids, byte ranges) of both sides by the two libraries on the whole text; none where bytes differ from space and text."""
    if not spelt.__dict__:
        spelt.a, spelt.b = Tokenizer.from_file(alignment.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
        spelt.a.encode_special_tokens = True
        letters = alignment.byte_letters()
        spelt.bytes_a = {i: bytes(letters.get(c, 0) for c in t) for t, i in spelt.a.get_vocab().items()}
        spelt.bytes_b = [bytes([int(p[3:5], 16)]) if spelt.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelt.b.id_to_piece(list(range(len(spelt.b)))))]
    a, b = spelt.a.encode(" " + text, add_special_tokens=False).ids, spelt.b.encode(text)
    out, want = [], (" " + text).encode()
    for ids, table in ((a, spelt.bytes_a), (b, spelt.bytes_b)):
        if not text or b"".join(table[i] for i in ids) != want:
            return [], []
        at, ranges = 0, []
        for i in ids:
            ranges.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(ranges)
    return out


def joined(a, b):
    links, j = [], 0
    for n, (_, s, e) in enumerate(a):
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((n, k))
            k += 1
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    return links, [(sum(x[2] <= e for x in a), sum(x[2] <= e for x in b)) for e in ends] if len(a) < 200 else ends


def test_alignment_statistics_are_those_of_plain_loops(mixed):
    docs, rows = mixed
    per, held = [], collections.Counter()
    for i, text in rows:
        a, b = spelt(text or "")
        links = [(a[x][0], b[y][0]) for x, y in joined(a, b)[0]]
        groups, x, y = [], 0, 0
        for e in sorted({t[2] for t in a} & {t[2] for t in b}):
            left, right = [], []
            while x < len(a) and a[x][2] <= e:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= e:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        held.update(set(links))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    want = collections.Counter((i, a, b, g, len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), d) for i, a, b, g, k, d in per)
    assert collections.Counter(map(tuple, alignment.link_statistics(docs).collect())) == want
    assert sum(1 for p in per if not p[1]) > 100 < sum(1 for p in per if p[1])


def test_aligned_texts_list_tokens_groups_and_links(spark, mixed):
    rows = [r for r in mixed[1] if len(r[1] or "") < 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, Alignment int")
    out = alignment.align_texts(docs)
    assert out.columns == ["doc_id", "text", "Alignment", "alignment_"]
    for r in out.collect():
        a, b = spelt(r.text or "")
        links, groups = joined(a, b)
        got = r.alignment_
        assert ([tuple(t) for t in got.a], [tuple(t) for t in got.b]) == (a, b)
        assert sorted(map(tuple, got.links)) == sorted(links) and [tuple(g) for g in got.groups] == groups


def test_blocks_cut_otherwise_count_alike(mixed):
    docs = mixed[0].where("doc_id <> 8")
    whole = sorted(map(tuple, alignment.link_statistics(docs).collect()), key=str)
    assert sorted(map(tuple, alignment.link_statistics(docs.coalesce(1)).collect()), key=str) == whole
    assert alignment.link_statistics(docs.where("false")).isEmpty()


# --- 13 --------------------------------------------------------------------------------------------------------------
def variants(counts, ratio=5):
    """(word, form, root, n, n_near, form_n) from deletion neighbourhoods."""
    gaps, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1:], i].add(w)
            if w[:i] + w[i + 1:] in counts:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: f for w, f in form.items() if counts[f] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def occurrences(rows, every=199, letters=6, least=5):
    out = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= letters and n >= least}


def test_spelling_variants_of_documents(spark):
    given = [(r.doc_id, r.text) for r in read(spark, FOLDER, "documents").collect()]
    rows = given + [(None, "Straße STRAßE Éclair éclairs"), (None, None), (4, ""), (5, "wordone " * 30 + "wordome " * 6 + "wörd" + "x" * 100_000), (5, "wordome"), (5, "wordome")]
    got = spelling.spelling_variants(frame(spark, rows), every=7)
    want = variants(occurrences(rows, every=7))
    assert got.count() == len(want) and set(map(tuple, got.collect())) == want
    assert spelling.spelling_variants(frame(spark, rows).where("false")).isEmpty()


def test_every_edit_is_found(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 9))) for _ in range(1500)} | {"a" * k for k in range(1, 60)} | {"ab" * 500, "ab" * 500 + "a", "b" + "ab" * 500}
    counts = {w: rng.choice([5, 6, 30, 200, 1000, 1000, 6000, 30_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = variants(counts)
    assert set(map(tuple, spelling.group_variants(df).collect())) == want
    assert any(r[1] and r[1] != r[2] for r in want)  # chains of forms
    pairs = {(r.word, r.near) for r in spelling.near_pairs(df, equal_parts=4, added_parts=2).collect()}
    assert len(pairs) == sum(r[4] for r in want)


def test_long_chains_of_forms(spark):
    chain = ["q" * 6 + "z" * k for k in range(27)]
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.root for r in spelling.roots(links).collect()} == {chain[-1]}


def test_signatures_of_near_words_meet():
    rng = random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12)))
        i, c = rng.randrange(len(w)), rng.choice("xyzab")
        for other in (w[:i] + c + w[i + 1:], w[:i] + c + w[i:]):
            if other == w:
                continue
            marks = [{(int(s[k]), role) for s, role in spelling.signatures(pa.array([w, other]))} for k in (0, 1)]
            if len(other) == len(w):
                assert {m for m in marks[0] if m[1] == 0} & {m for m in marks[1] if m[1] == 0}
            else:
                assert {m[0] for m in marks[0] if m[1] == 1} & {m[0] for m in marks[1] if m[1] == 2}


def test_signatures_of_few_words_are_not_broadcast(spark, tmp_path):
    """Spark sized the 32 signatures a word as one row, so a table just below its threshold went through the driver."""
    words = [(f"word{n:05}x", 5 + n % 40) for n in range(400)]
    spark.createDataFrame(words, "word string, n long").write.parquet(str(tmp_path / "words"))
    pairs = spelling.near_pairs(spark.read.parquet(str(tmp_path / "words")))
    assert pairs.count() > 0
    for plan in (pairs._jdf.queryExecution().executedPlan().toString(), pairs._jdf.queryExecution().optimizedPlan().toString()):
        assert "Broadcast" not in plan
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_held_a_few_at_a_time(spark, monkeypatch):
    """a row group, which Spark reads as one batch, held all the blocks of a task, megabytes each."""
    written, plain = [], alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda *a: written.append(plain(*a)) or written[-1])
    monkeypatch.setattr(alignment, "BLOCK", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    docs = frame(spark, [(i, f"one text of some length, number {i}") for i in range(60)])
    assert alignment.link_statistics(docs.coalesce(1)).count() == 60
    spark.conf.set(key, before)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written[0].inputFiles()]
    sizes = [g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)]
    assert sum(sizes) == 20 and max(sizes) <= alignment.GROUP_ROWS


def test_words_of_earlier_runs_are_not_solved_again(monkeypatch):
    with open(alignment.BYTE_BPE, "rb") as a, open(alignment.PIECE_BPE, "rb") as b:
        machine = alignment.Tokenizers(a.read(), b.read())
    solved, plain = [], machine.first_side
    monkeypatch.setattr(machine, "first_side", lambda text: solved.append(text) or plain(text))
    texts = [pa.array([f"one two {n % 7} wörds  more  " for n in range(k, k + 40)]) for k in (0, 7, 5)]
    ids = lambda column: [(r.a.ids.tolist(), r.b.ids.tolist()) for r in alignment.align(column, machine)]
    first = ids(texts[0])
    assert solved and ids(texts[1]) == first  # the same words in the same order
    solved.clear()
    third = ids(texts[2])
    assert not solved
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 3)
    assert ids(texts[2]) == third and solved
