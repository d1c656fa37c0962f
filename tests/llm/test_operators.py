"""Each operator against brute force on small tables that hold nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from millrace.llm import ann, common, components, html_extract, html_train, langid, license_scan, line_dedup, mixing, near_copies, packing, queries, simhash, topk, warc

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, bin string, h1 int, node long"


def docs_table(spark, rows):
    """``(doc_id, text, lang, source)`` with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "b", 2, 3) for r in rows], DOCS)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(120)]
    line = lambda: " ".join(r.choices(words, k=r.randint(1, 30)))
    rows = []
    for i in range(n):
        text = "\n".join(line() for _ in range(r.randint(1, 6)))
        if i and r.random() < 0.4:
            old = rows[r.randrange(len(rows))][1] or ""
            w = old.split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w) if r.random() < 0.6 else old
        rows.append((i, text, r.choice(["en", "fr"]), f"s{i % 4}" if i % 7 else None))
    rows += [(900, None, None, "s0"), (901, "", "en", None), (902, " \n\t", "en", "s1"), (903, " ".join(words * 60), "fr", "s2"), rows[5], rows[5], (None, "lonely text here", "en", "s3"), (None, rows[7][1], None, "s3"), (904, "Ünï cödé!", "de", "s1")]
    return rows


EMPTY: list = []


# --- 1 ---


def test_mixing_targets():
    assert mixing.targets_by_weight({"b": 100, "a": 10, None: 100}, 210) == {"a": 30.0, "b": 72.0, None: 108.0}
    assert sum(mixing.targets_by_weight({"a": 1, "b": 0, "c": 5}, 6).values()) == pytest.approx(6)


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "en", f"s{i % 3}") for i in range(600)] + corpus()
    got = mixing.mix(docs_table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").split())) for r in rows)
    again = mixing.mix(docs_table(spark, rows[::-1])).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[(r.source_size, r.target)][0] += r.taken
    for (size, target), (taken, _) in by.items():
        assert target <= 3 * size and abs(taken - target) <= max(0.03 * target, 40)
    # the rates solve the dual: with whole rates in between they are exponentially tilted by size
    assert mixing.mix(docs_table(spark, EMPTY)).count() == 0
    assert mixing.mix(docs_table(spark, [(1, None, None, None)])).collect()[0].taken == 0


def test_mixing_of_rows_without_ids(spark):
    """Rows of one id, also equal ones, are taken in part; names of columns don't matter."""
    rows = [(None, " ".join(["w"] * (1 + i % 5)) + (f" {i}" if i % 2 else ""), "en", f"s{i % 2}") for i in range(1000)]
    docs = docs_table(spark, rows).withColumnsRenamed({"key": "mixed_id", "size": "mixed_copies", "bin": "own"})
    by = defaultdict(int)
    for x in mixing.mix(docs).collect():
        by[x.target] += x.taken
    assert len(by) == 2 and all(abs(taken - target) <= 0.02 * target for target, taken in by.items())
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert sum(len(x.text.split()) for x in out.collect()) == sum(by.values())


def test_letters_are_letters(spark):
    assert all(langid.text_features(t) is None for t in ("½", "²³", "①②", "12 _ -", "", None)) and langid.text_features("½ a") is not None
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 5), (2, "½", "en", "s", 1), (3, None, "en", "s", 1)], "doc_id long, text string, lang string, lang_pred string, score int")
    got = langid.known_language(docs)
    assert got.columns == docs.columns and [tuple(x) for x in got.collect()] == [(1, "the cat and the dog", "en", "s", 5)]


def test_rates_meet_their_targets(spark):
    h = [("a", s, n) for s, n in [(1, 5), (10, 3), (400, 2)]]
    size = float(sum(s * n for _, s, n in h))
    for share in (0.01, 0.4, 1.0, 1.7, 2.99):
        lam = mixing.solve_rates(spark.createDataFrame(h, "key string, size long, n long"), {"a": share * size}, {"a": size}, {"a": size / 10}, 3.0)["a"]
        assert sum(min(3.0, np.exp(lam * s / (size / 10))) * s * n for _, s, n in h) == pytest.approx(share * size, rel=1e-5)


# --- 2 ---


def test_warc(spark):
    rows = [(3, "http://www.A.com/x?q=1", "<p>é</p>"), (1, "http://www.a.com/x?q=1", "same"), (2, "https://b.org:8443", "same"), (4, None, None), (5, "not a url\n", ""), (6, "http://[bad", "same"), (7, "http://a.com/" + "p" * 3000, "z" * 300_000), (None, "http://n/", "same"), (9, "http://a.com/", "solo"), (9, "http://a.com/", "solo")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, hex string, key int")
    archive = warc.write_archive(pages, block_lines=2)
    got = warc.look_up(archive, pages).collect()
    wanted = []
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        wanted.append((i or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(wanted, key=str)
    assert warc.look_up(archive, spark.createDataFrame([("http://none/", 1)], "url string, page_id long")).count() == 0
    assert warc.round_trip(pages.where("false")).count() == 0
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(archive.root)
    found = [x for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("warc-") for x in warc.read_members(fs.open_input_stream(f.path).read())]
    assert len(found) == len(rows) and all(x["payload"] == b"" for x in found if x["type"] == "revisit")
    assert warc.sort_key("http://www.a.com:80/x?y") == "com,a,www:80)/x?y" and warc.sort_key(None) == ""


# --- 3 ---


def test_html_held_out():
    right = total = 0
    texts = 0
    for seed in range(50_000, 50_120):
        page = html_train.Writer(seed).page()
        tree = html_extract.parse(page)
        x, y = html_train.labelled(seed)
        kept = html_extract.decode(tree.parent, np.concatenate([[9.0], html_extract.Forest.load().margin(x)]))
        good = [kept[n] == (y[n - 1] == 1) for n, _ in tree.runs if n]
        right, total, texts = right + sum(good), total + len(good), texts + all(good)
    assert right / total > 0.99 and texts > 105


def test_html_edges(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/b>About</a></nav><article><h1>A title of it</h1><p>First  &amp; long\n paragraph, it says a lot of things, the more the better.<script>x</script><p>Second paragraph &eacute;, with <b>bold</b> text and more of it.</article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<" * 500 + "&#xD;"), (5, "u", "<div>" * 3000 + "deep"), (1, "u", page)]
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    text = "A title of it\nFirst & long paragraph, it says a lot of things, the more the better.\nSecond paragraph é, with bold text and more of it."
    assert {(1, text, len(text)), (2, "", 0), (3, "", 0)} <= got
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_is_consistent():
    r = np.random.default_rng(0)
    for _ in range(30):
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, 7)]
        margin = r.normal(0, 3, 7)
        margin[0] = 9
        got = html_extract.decode(parent, margin)
        value = lambda keep: sum(-np.logaddexp(0, -m if k else m) for k, m in zip(keep, margin))  # noqa: B023, E731
        best = max(value(k) for k in itertools.product([True, False], repeat=7) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, 7)))
        assert value(got) == pytest.approx(best)


# --- 4 ---


def brute_lines(rows):
    """Text, lines and removed lines of each distinct (doc_id, text)."""
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[0] is not None and r[1] is not None})
    seen, out = [], {}
    for _, doc, text in order:
        kept, gone = [], 0
        for line in text.split("\n"):
            w = frozenset(line.split())
            if w and any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[doc, text] = ("\n".join(kept), text.count("\n") + 1, gone)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    rows = [r for r in rows if r[0] is not None] + [(None, "only here zz\nonly here zz", "en", "s")]
    got = line_dedup.dedup_lines(docs_table(spark, rows)).collect()
    wanted = brute_lines(rows)
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.text, r.n_lines, r.n_removed))
    for (doc, _), v in wanted.items():
        assert v in by[doc]
    assert by[900] == {(None, 0, 0)} and by[None] == {("only here zz", 2, 1)}
    assert line_dedup.dedup_lines(docs_table(spark, EMPTY)).count() == 0


def test_line_dedup_crowds(spark):
    """A large group of near copies of one line, a line of most documents, words of every line, and clashing columns; against brute force."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = r.sample(words, 40)
    rows = []
    for i in range(240):
        near = list(base)
        for _ in range(r.randint(0, 9)):
            near[r.randrange(40)] = r.choice(words)
        lines = [" ".join(near), "the line that is in every document", " ".join(r.choices(words, k=r.randint(1, 60))), "  two\tparts " + r.choice(words) + " " + str(i % 9)]
        r.shuffle(lines)
        rows.append((i if i % 50 else 7, "\n".join(lines), "en", "s"))
    columns = "doc_id long, text string, lang string, source string, n_lines string, n_removed int, gone int, own string, lines long, th long"
    docs = spark.createDataFrame([(*x, "n", 1, 2, "o", 3, 4) for x in rows], columns)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and dict(got.dtypes)["n_lines"] == "int"
    seven = {x[1] for x in rows if x[0] == 7}
    wanted = brute_lines([x for x in rows if x[0] != 7])
    alone = {x.doc_id: x for x in line_dedup.dedup_lines(docs.where("doc_id <> 7")).collect()}
    assert {(i, x.text): (x.n_lines, x.n_removed) for i, x in alone.items()} == {(i, t): (n, m) for (i, _), (t, n, m) in wanted.items()}
    every = got.collect()
    assert len(every) == len(rows) and len({x.text for x in every if x.doc_id == 7}) == len(seven) and {(x.gone, x.own, x.lines, x.th) for x in every} == {(2, "o", 3, 4)}
    plain = line_dedup.dedup_lines(docs, counts=False)
    assert plain.columns == docs.columns and {x.n_lines for x in plain.collect()} == {"n"}


def test_line_dedup_long_texts(spark):
    """A line of 100,000 words and a text of 40,000 lines, most of which go."""
    r = random.Random(1)
    long = " ".join(f"w{k}" for k in range(100_000))
    many = [f"line number {k % 5000} of the text {k % 5000}" for k in range(40_000)]
    r.shuffle(many)
    rows = [(1, long, "en", "s"), (2, long + " more", "en", "s"), (3, "\n".join(many), "en", "s")]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs_table(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].text == "" and got[3].n_removed == 40_000 - len(got[3].text.split("\n"))
    kept = brute_lines([(3, "\n".join(dict.fromkeys(many[:300])), "en", "s")])
    assert got[3].text.split("\n")[0] == next(iter(kept.values()))[0].split("\n")[0]


def test_line_dedup_parities(spark):
    """Keys can't be null, so that they are sorted as plain numbers; parities never tell more differences than there are, on both sides of ``SHORT``."""
    r = random.Random(7)
    rows = []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(line_dedup.SHORT - 8 + i % 17)]
        rows.append((2 * i, " ".join(words), "en", "s"))
        near = [w for w in words if r.random() > 0.1] + [f"v{i}x{k}" for k in range(r.randint(0, 9))]
        r.shuffle(near)
        rows.append((2 * i + 1, " ".join(near + near[:3]), "en", "s"))
    docs = docs_table(spark, rows)
    lines = docs.selectExpr("doc_id id", "text line")
    sets = line_dedup._sets(lines, line_dedup.rarity(docs))
    assert not sets.schema["keys"].dataType.containsNull
    keys = {x.id: x["keys"] for x in sets.collect()}
    assert all(k == sorted(set(k)) and len(k) == len(set(rows[i][1].split())) for i, k in keys.items())
    sigs = {x.id: (x.n, x.sig, x.sig2) for x in line_dedup._entries(sets).collect()}
    ones = lambda x: bin(x & (1 << 64) - 1).count("1")
    for i in range(0, 120, 2):
        (n, a, b), (m, c, d) = sigs[i], sigs[i + 1]
        apart = ones(a ^ c ^ b ^ d) + ones(b ^ d) if min(n, m) > line_dedup.SHORT else ones(a ^ c)
        assert apart <= len(set(keys[i]) ^ set(keys[i + 1]))
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: v for (i, _), v in brute_lines(rows).items()} and 0 < sum(v[2] for v in got.values()) < 60


def test_line_dedup_splits_lines_once(spark, monkeypatch):
    """The words of lines are split and hashed in one plan, whether ids are broadcast or shuffled."""
    calls, words = [], line_dedup._words
    monkeypatch.setattr(line_dedup, "_words", lambda line: calls.append(1) or words(line))
    rows = [r for r in corpus(3, 30) if r[0] is not None]
    docs, wanted = docs_table(spark, rows), set(brute_lines(rows).values())
    for small in (line_dedup.SMALL, 0):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        calls.clear()
        got = {(x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(docs).collect()}
        assert len(calls) == 1 and wanted <= got


# --- 5, 7 ---


def vectors(spark, n=400, dim=16, seed=0):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, dim)) * 0.2).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * dim), (1200, [float("nan")] * dim), (1300, [float("inf"), 1.0]), (1400, [None] * dim), (1500, [1.0, 2.0]), (None, [1.0] * dim), (3, x[3].tolist())]
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, cell int, x string, score double"), {i: np.pad(np.array(v, dtype=np.float64), (0, dim - len(v))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}


def best(of, measure, k, step):
    out = {}
    for q in of:
        if q % step == 0:
            line = sorted(((-measure(of[q], v), i) for i, v in of.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in line]
    return out


def test_top_k(spark):
    table, of = vectors(spark)
    of = {i: np.floor(1024 * v) for i, v in of.items()}
    wanted = best(of, lambda a, b: int(a @ b), 10, 100)
    got = defaultdict(list)
    for r in topk.search(table, rows=64, query_rows=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == wanted
    assert topk.search(table.where("false")).count() == 0 and topk.search(table.where("vec_id = 1")).count() == 0
    x = np.random.default_rng(1).normal(size=(500, 3)) * 50
    bound = np.where(np.arange(500) < 20, 1e9, (np.linalg.norm(x, axis=1) * 90))
    ids, score, seen = topk.scan(np.array([50.0, 50, 50]), x, np.arange(500), bound, 3, -1, step=16)
    assert list(ids) == list(np.argsort(-(x @ np.array([50.0, 50, 50])), kind="stable")[:3]) and seen < 500


def test_nearest(spark):
    table, of = vectors(spark)
    of = {i: v / np.linalg.norm(v) for i, v in of.items() if np.linalg.norm(v)}
    wanted = best(of, lambda a, b: float(a @ b), 5, 50)
    got = defaultdict(list)
    for r in ann.search(table, rows=64, query_rows=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(wanted)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hit >= 0.9 * sum(map(len, wanted.values()))
    for q, line in got.items():
        assert all(s == pytest.approx(float(of[q] @ of[i]), abs=1e-12) for i, s in line) and [s for _, s in line] == sorted((s for _, s in line), reverse=True)
    assert ann.search(table.where("false")).count() == 0 and ann.search(table.where("vec_id = 1100")).count() == 0


def test_nearest_in_a_crowd_of_copies(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 16)).astype(np.float32)
    x[100:400] = x[0]
    x[400:420] = x[0] + (r.normal(size=(20, 16)) * 0.01).astype(np.float32)
    order = r.permutation(500)
    table = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for h in ann.search(table, is_query="vec_id in (0, 150, 350)").orderBy("query_id", "rank").collect():
        got[h.query_id].append(h.vec_id)
    assert got == {0: [100, 101, 102, 103, 104], 150: [0, 100, 101, 102, 103], 350: [0, 100, 101, 102, 103]}


@here
def test_recall_on_the_tables(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    of = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e}
    of = {i: v / np.linalg.norm(v) for i, v in of.items()}
    wanted = best(of, lambda a, b: float(a @ b), 5, 50)
    got = Counter((r.query_id, r.vec_id) for r in queries.op5_ann(spark, SF).collect())
    assert sum((q, i) in got for q in wanted for i, _ in wanted[q]) >= 0.9 * 5 * len(wanted)


def test_ann_goes_on_until_it_has_enough(spark):
    """2,000 equal vectors and three others: every query has its five."""
    r = np.random.default_rng(1)
    one = r.normal(size=8).tolist()
    rows = [(i, one) for i in range(1, 2001)] + [(5000 + 50 * k, r.normal(size=8).tolist()) for k in range(3)]
    got = defaultdict(list)
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=2).collect():
        got[x.query_id].append((x.rank, x.vec_id))
    assert len(got) == 43 and all(len(v) == 5 for v in got.values())
    assert [v for _, v in sorted(got[50])] == [1, 2, 3, 4, 5]


# --- 6 ---


@here
def test_language_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op6_langid(spark, SF).collect() if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 150 and sum(docs[r.doc_id].lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edges(spark):
    rows = [(i, ("the house and the tree is green of it " if i % 2 else "le chat et la maison sont des rouges du ") * 3, "en" if i % 2 else "fr", "s") for i in range(80)]
    rows += [(200, None, "en", "s"), (201, "123 !!", None, "s"), (202, "", "en", None), (203, "the and of " * 20000, None, None), (None, "la maison et le chat", None, None), rows[0]]
    got = langid.identify(docs_table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "en", "fr"] and by[200].score == 0
    assert langid.identify(docs_table(spark, EMPTY)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_table(spark, [(1, "text", None, "s")])).collect()} == {"und"}
    kept = langid.known_language(docs_table(spark, rows))
    assert kept.columns == docs_table(spark, EMPTY).columns and kept.count() == len(rows) - 3
    assert langid.family("fr") == langid.family("es") == "romance" and langid.family("xx") == "other"


# --- 8 ---


def plain_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rows = [r for r in corpus(3, 120) if r[0] is not None]
    got = simhash.near_duplicates(docs_table(spark, rows)).collect()
    fp = {r[0]: plain_fingerprint(r[1]) for r in rows}
    wanted = brute_components(fp)
    assert len(got) == len(rows) and {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", wanted[i]) for i in fp}
    assert simhash.near_duplicates(docs_table(spark, EMPTY)).count() == 0
    nulls = simhash.near_duplicates(docs_table(spark, [(None, "a b c", None, None), (None, None, None, None), (4, "", None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in nulls) == [("4", "4"), ("None", "4"), ("None", "None")]
    kept = simhash.keep_one(docs_table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(wanted.values()))


def test_keep_one_keeps_each_component(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, "en", "s"), (None, b, "en", "s"), (None, c, "en", "s"), (7, c, "en", "s"), (8, d, "en", "s"), (8, e, "en", "s"), (8, e, "en", "s")]
    kept = simhash.keep_one(docs_table(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted([("None", a), ("None", b), ("7", c), ("8", d), ("8", e)])


@pytest.mark.parametrize("dense", [0, 8, 64])
def test_links_lose_nothing(spark, dense):
    r = random.Random(dense)
    centre = [r.getrandbits(64) for _ in range(6)]
    fps = {r.getrandbits(64) for _ in range(100)} | set(centre)
    for c in centre[:3]:
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), dense=dense)
    got = {x.node: x.root for x in components.connected_components(links).collect()}
    ids = {signed(x): x for x in fps}
    wanted = brute_components(ids)
    assert all(got.get(i, i) == wanted[i] for i in ids)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def near_rows(seed):
    """Chains, a crowd and borders of near copies, besides exact ones, empty ones, null and repeated ids."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randint(0, 99))
    texts = ["", "a b", "A  b", "a b c"]
    for n in (12, 40, 90, 200):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join(base).upper()]
            for _ in range(14):
                if r.random() < 0.5:
                    base = list(base)
                w = list(base)
                for _ in range(r.randint(1, max(1, n // 30))):
                    w[r.randrange(n)] = word()
                texts.append(" ".join(w))
                base = w if r.random() < 0.5 else base
    passage = " ".join(word() for _ in range(30))
    texts += [" ".join([passage, *(word() for _ in range(20))]) for _ in range(30)]
    r.shuffle(texts)
    return [(i if i % 9 else None, t, "en", "s") for i, t in enumerate(texts)] + [(1, texts[1], "en", "s"), (1, "another text altogether", "en", "s")]


def brute_near(texts):
    sets = {}
    for t in set(texts):
        w = t.lower().split()
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 9 * len(x & y) >= 4 * (len(x) + len(y)):
            root[find(a)] = find(b)
    return {t: find(t) for t in sets}


@pytest.mark.parametrize(("seed", "rounds"), [(0, 2), (1, 0)])
def test_near_copies_against_brute_force(spark, seed, rounds):
    rows = near_rows(seed)
    docs, wanted = docs_table(spark, rows), brute_near([x[1] for x in rows])
    rooted = near_copies.with_row(docs).join(near_copies.near_copies(docs, rounds), list(near_copies.ROW)).select("text", "root").distinct().collect()
    of = {x.text: x.root for x in rooted}
    assert set(of) == set(wanted) and len(rooted) == len(of)
    assert len({(of[t], wanted[t]) for t in of}) == len(set(of.values())) == len(set(wanted.values())) < len(of)
    kept = [wanted[x.text] for x in near_copies.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) == len(set(wanted.values()))
    assert near_copies.keep_one(docs_table(spark, EMPTY)).count() == 0


# --- 9 ---


@pytest.mark.parametrize("seed", [0, 1])
def test_parities_never_exceed_the_difference(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 5, 60, 600, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (near_copies._parity(a) ^ near_copies._parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_copies_of_a_crowd_without_a_centre(spark, rounds):
    """Copies of one text with none to three words of their own: many pairs are just not similar enough, and chains decide."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 1, 2, 2, 3])):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    wanted = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and wanted[i] != wanted[j]:
            old, new = max(wanted[i], wanted[j]), min(wanted[i], wanted[j])
            wanted = [new if x == old else x for x in wanted]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {x.did: x.root for x in near_copies.near_copies(docs, rounds).collect()}
    got = [min(k for k in root if root[k] == root[i]) for i in range(len(texts))]
    assert got == wanted and 1 < len(set(wanted))


def test_best_fit():
    bins, starts = packing.best_fit([6, 5, 4, 3, 2], [-1] * 5, [-1] * 5, 10)
    assert bins == [0, 1, 0, 1, 1] and starts == [0, 0, 6, 5, 8]
    assert packing.best_fit([4, 4, 2], [1, 1, -1], [-1] * 3, 10)[0] == [0, 1, 0]
    r = random.Random(0)
    for _ in range(20):
        n = 40
        size, src, dup = [r.randint(0, 20) for _ in range(n)], [r.randint(-1, 5) for _ in range(n)], [r.randint(-1, 9) for _ in range(n)]
        got, _ = packing.best_fit(size, src, dup, 20)
        state: list[tuple[int, set, set]] = []
        for i in sorted(range(n), key=lambda k: (-size[k], k)):
            fits = [(left, b) for b, (left, s, d) in enumerate(state) if left >= size[i] and left and src[i] not in s and dup[i] not in d]
            b = min(fits)[1] if fits else len(state)
            if not fits:
                state.append((20, set(), set()))
            left, s, d = state[b]
            state[b] = (left - size[i], s | ({src[i]} if src[i] >= 0 else set()), d | ({dup[i]} if dup[i] >= 0 else set()))
            assert got[i] == b


def test_packing(spark):
    rows = corpus(5, 150)
    got = packing.pack(docs_table(spark, rows), capacity=100, shard_rows=60).collect()
    words = Counter()
    bins = defaultdict(list)
    for r in got:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
        assert r.n_words <= 100 and r.start + r.n_words <= 100
    wanted = Counter()
    for r in rows:
        wanted[r[0]] += len((r[1] or "").split())
    assert words == wanted and {r.doc_id for r in got} == {r[0] for r in rows}
    source, text = {r[0]: r[3] for r in rows}, {r[0]: " ".join((r[1] or "").lower().split()) for r in rows}
    for line in bins.values():
        spans = sorted((r.start, r.start + r.n_words) for r in line if r.n_words)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        src = [source[r.doc_id] for r in line if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(src) == len(set(src))
        assert len({text[r.doc_id] for r in line if r.doc_id is not None}) == sum(r.doc_id is not None for r in line)
    assert packing.pack(docs_table(spark, EMPTY)).count() == 0


def test_packing_of_equal_rows_and_large_ids(spark):
    assert packing.best_fit([1] * 8000, [-1] * 8000, [3] * 8000, 10)[0] == list(range(8000))
    big = 2**60 + 1
    rows = [(big, "a b c", "en", "s"), (None, "a b c d", "en", "s"), (big + 2, "x", "en", "t")]
    assert sorted((x.doc_id or 0, x.n_words) for x in packing.pack(docs_table(spark, rows)).collect()) == [(0, 4), (big, 3), (big + 2, 1)]


def test_word_count(spark):
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb c", "a \nb", "a\tb\x0bc", "é\u00a0ü x", None, "\n", "a\r\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.word_count(F.col("t")).alias("n")).collect()
    assert [(x.t, x.n) for x in got] == [(t, len(re.findall(common.WORD, t or ""))) for t in texts]


def test_packing_keeps_near_copies_apart(spark):
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: 3 * i], f"other{i}", *base[3 * i + 1 :]]), "en", f"s{i}") for i in range(1, 11)] + [(0, " ".join(base), "en", "s0")]
    got = packing.pack(docs_table(spark, rows)).collect()
    assert len(got) == 11 and len({x.bin_id for x in got}) == 11


# --- 10 ---


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Released under the MIT License.", ["MIT"]), ("my essay. released under MIT license, bye", ["MIT"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("the license plate was red", []), ("", []), ("x\n" * 50_000 + "Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License,\nVersion 2.0 (the 'License'); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: ISC", ["ISC"]), ("SPDX-License-Identifier: banana", []), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]),
    ],
)
def test_licenses(text, wanted):
    assert [x[0] for x in license_scan.scan(text)] == wanted


def test_license_parts(spark):
    assert license_scan.differences("a b c".split(), "x a c y".split())[0] == 1
    for name, template in license_scan.TEMPLATES:
        top = license_scan.savings(template)[0]
        assert license_scan.TEMPLATES[top[1]][0] == name
        assert name in [x[0] for x in license_scan.scan(f"Some words before it.\n{template}\nAnd after it.")]
    assert zstandard.ZstdCompressor
    rows = [(1, "Released under the MIT License.", None, None), (1, "Released under the MIT License.", None, None), (2, None, None, None), (None, "Licensed under CC BY 4.0.", None, None)]
    assert sorted((str(r.doc_id), r.license) for r in license_scan.scan_licenses(docs_table(spark, rows)).collect()) == [("1", "MIT"), ("1", "MIT"), ("None", "CC-BY-4.0")]
    assert license_scan.scan_licenses(docs_table(spark, EMPTY)).count() == 0


GRANT = dict((name, text) for name, text in license_scan.TEMPLATES if name in ("MIT", "ISC"))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("All photographs, maps and tables on this page are licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("The little program that draws the tide tables for the harbour and the river is released under the MIT License.", ["MIT"]),
        ("a line of other words " * 40 + "this work is licensed under\nCC BY-SA 4.0\n" + "and many more lines\n" * 30, ["CC-BY-SA-4.0"]),
        ("\n".join(GRANT["MIT"].split()), ["MIT"]),
        ("word " * 300 + GRANT["ISC"] + " word" * 300, ["ISC"]),
        ("Licensed under the Apache License, Version 3.0. Licensed under this Apache License, Version 2.0.", ["Apache-2.0"]),
        ("All photographs on this page are licensed to us by 4 agencies under terms of 2019.", []),
    ],
)
def test_notices_inside_other_text(text, wanted):
    assert [x[0] for x in license_scan.scan(text)] == wanted


# --- queries with SQL ---


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
