"""The llm operators against brute force, hand-worked cases and round trips, and on nulls, empties, ties and odd columns."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import table as comparable

from quillspark.llm import components, decontam, hnsw_dedup, license_scan, line_dedup, ngram_join, packing, quality, queries, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, component_id string, cuts int, lost_keys string"
WORDS = [a + b for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("ron", "tis", "mol", "ka", "pur", "sen", "vo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(12)]
    out = [(None, "no id"), (0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "ONE two"), (5, "one two three")]
    for k, t in enumerate(base):
        w = t.split()
        out.append((10 + 10 * k, t))
        out.append((11 + 10 * k, t.upper()))
        for j in range(3):  # edits from few to many
            v = list(w)
            for _ in range((1, 2, 6)[j]):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(99))
            out.append((12 + j + 10 * k, " ".join(v)))
    out.append((500, prose(rng, 5000)))
    return out + [(10, base[0])]


def union_find(n, links):
    p = {x: x for x in n}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {x: root(x) for x in n}


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 300])
def test_ngram_join_is_exact(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # a few sets a block: many cells
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.similar(docs_of(spark, corpus)).collect()}
    sets = {}
    for i, t in corpus:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(ids, links)
    assert got == {(i, len(sets[i])): want.get(i) for i in sets}
    assert want[11] == 10 and want[4] == 3 and want[5] == 5


def test_ngram_join_joins_prefixes_of_pairs_only(spark, monkeypatch):
    """Of many texts without a like, hardly any go into the join of candidates, and the prefixes of all are gone by then."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for i in range(400)]
    rows += [(1000 + i, " ".join([*t.split()[:-1], "other"])) for i, t in rows[:5]]
    seen, dropped, verify, drop = [], [], ngram_join._verify, ngram_join.work.drop

    def watched(pairs, prefixes, *more):
        seen.append((prefixes.count(), sum("/prefixes-" in x for x in dropped)))
        return verify(pairs, prefixes, *more)

    def noted(*tables):
        dropped.extend(getattr(t, "_quill_path", "") for t in tables)
        drop(*tables)

    monkeypatch.setattr(ngram_join, "_verify", watched)
    monkeypatch.setattr(ngram_join.work, "drop", noted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar(docs_of(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert len(seen) == 1 and 10 <= seen[0][0] < 40 and seen[0][1] == 1


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar(docs_of(spark, [])).count() == 0
    kept = ngram_join.keep_first(docs_of(spark, [(3, "a b c"), (1, "a B c"), (2, None), (None, "a b c")]))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 1), (False, 2)] and kept.count() == 3


def test_overlaps_by_products():
    rng = np.random.default_rng(0)
    one, two = ([np.unique(rng.integers(0, 60, 30)) for _ in range(5)] for _ in range(2))
    assert ngram_join._overlaps(one, two, 7).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_components_of_chain_cycle_and_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1)] + [(50, x) for x in range(51, 90)] + [(7, 7), (None, 4)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, **{x: 50 for x in range(50, 90)}}


LONG = "This line is long enough to be counted by the operator, "


def line_rows(rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, ts in texts.items():
        for t in ts:
            for line in (t or "").split("\n"):
                if i is not None and len(key(line)) >= 40:
                    holds[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holds[key(x)]) < 5 or i == max(holds[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_and_its_reversal(spark):
    rows = [(i, f"{LONG}A\nown {i}\n  {LONG.upper()}b \nshort\n" + ("É" * 41 if i % 2 else "é" * 41)) for i in range(6)]
    rows += [(10, None), (11, ""), (12, f"{LONG}A\n{LONG}A"), (None, f"{LONG}A"), (13, "x" * 100_000)]
    got = lambda index, r: sorted((tuple(x) for x in line_dedup.digest(line_dedup.apply(docs_of(spark, r), index)).collect()), key=str)
    index = line_dedup.build(docs_of(spark, rows), shards=3)
    assert got(index, rows) == line_rows(rows)
    more = [(20 + i, f"{LONG}new") for i in range(5)]
    grown = line_dedup.insert(index, docs_of(spark, more))
    assert got(grown, rows + more) == line_rows(rows + more)
    back = line_dedup.delete(grown, spark.createDataFrame([(20 + i,) for i in range(5)] + [(0,), (1,), (2,)], "doc_id long"))
    rest = [r for r in rows if r[0] not in (0, 1, 2)]
    assert got(back, rest) == line_rows(rest)
    anew = line_dedup.build(docs_of(spark, rest), shards=3)
    for one, two in ((back.counts, anew.counts), (line_dedup.compact(back).refs, anew.refs)):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sum(r["n_keys"] for r in back.filters.collect()) == sum(r["n_keys"] for r in anew.filters.collect())
    both = spark.createDataFrame([(1, f"{LONG}A\nx", "old", -1)], "doc_id long, text string, n_lines string, n_dropped int")
    assert [tuple(r) for r in line_dedup.apply(both, index).collect()] == [(1, "x", 2, 1)]
    assert line_dedup.apply(docs_of(spark, []), line_dedup.build(docs_of(spark, []))).count() == 0


def test_cuckoo_filter_forgets_what_is_deleted():
    keys = np.random.default_rng(1).integers(1, 1 << 63, 3000, np.uint64)
    f = line_dedup._filter_of(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.n == 1000 and f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01
    assert line_dedup.CuckooFilter.load(f.cells.tobytes(), f.n).contains(keys[1000:2000]).all()


def test_url_filter(spark):
    urls = ["http://a.example.com/en/7?x", "http://example.com/en/8", "HTTPS://EXAMPLE.COM/en/7", "http://badcom/en/", "ftp://x.net/de/1#f", "http://b.example.net/de/88", "none", None, "", "http://com", "http://org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "allow") for i, u in enumerate(urls)] + [(0, urls[0], "h", "x")], "page_id long, url string, html string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, url_filter.rules_table(spark)).collect()]
    first = (0, "a.example.com", "/en/7", "example.com/en/7", "allow")
    assert sorted(got) == [first, first, (1, "example.com", "/en/8", "com/en/", "block"), (2, "example.com", "/en/7", "example.com/en/7", "allow"), (3, "badcom", "/en/", None, "allow"), (4, "x.net", "/de/1", "net/de/", "allow"), (5, "b.example.net", "/de/88", "example.net/de/8", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "com", "", None, "allow"), (10, "org", "/es/", "org/es/", "block")]
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, url_filter.rules_table(spark).limit(0)).collect()} == {"allow"}


def test_url_filter_against_brute_force(spark, monkeypatch):
    """Many rules, some with both verdicts; a full-size filter and one so small that most candidates pass it."""
    rng = random.Random(17)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = [(rng.choice(hosts), path(), rng.choice(("allow", "block"))) for _ in range(400)] + [(None, "/", "block"), ("a", None, "block")]
    urls = [f"http://{rng.choice('ab')}.{rng.choice(hosts).upper()}{path()}{rng.choice(('', '?q', '#f'))}" for _ in range(600)] + ["http://a/" + "x/" * 200_000]
    rule_of = {}
    for h, p, v in rules:
        if h and p and rule_of.get((h, p)) != "block":
            rule_of[h, p] = v
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://")[1].split("?")[0].split("#")[0]
        h, _, p = rest.partition("/")
        h, p = h.lower(), "/" + p if "/" in rest else ""
        fits = [(len(a + b), len(a), a + b, v) for (a, b), v in rule_of.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want.append((i, h, p, *(max(fits)[2:] if fits else (None, "allow"))))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (1 << 20, 1):
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        assert sorted(tuple(r) for r in url_filter.url_filter(pages, table).collect()) == want


def test_quality_on_held_out_rows(spark):
    """Word vectors alone tell the classes apart on rows not learnt from, and scores are probabilities."""
    sf = "/root/testdata/sf0.1"
    from quillspark.llm.work import table

    got = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert got.count() == table(spark, sf, "documents").count()
    rows = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    good, s = rows["quality"] == 1, rows["score"]
    assert (rows["predicted"] == rows["quality"]).mean() >= 0.98 and len(rows) > 500
    assert s[good].rank().mean() and (s[good].to_numpy()[:, None] > s[~good].to_numpy()[None, :]).mean() > 0.99
    tenth = np.minimum((s * 10).astype(int), 9)
    assert sum(abs(s[tenth == k].mean() - good[tenth == k].mean()) * (tenth == k).mean() for k in set(tenth)) < 0.02
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) for d in rows["doc_id"])


def test_temperature_calibrates():
    """Labels that words explain in part only: the scores say how often, not more."""
    rng = random.Random(31)
    y = np.array([rng.random() < 0.5 for _ in range(900)], int)
    texts = [f"{('bad', 'good')[int(v) if rng.random() < 0.8 else 1 - int(v)]} {prose(rng, 11)}" for v in y]
    m = quality.fit(texts[:600], y[:600])
    words = quality.Words(m.vocabulary)
    s = m.score(np.array([quality.pooled(words, m.context, t) for t in texts[600:]]))
    assert m.temperature > 1 and np.logaddexp(0, -np.where(y[600:] > 0, 1, -1) * np.log(s / (1 - s))).mean() < 0.69


def test_word_numbers_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(quality, "CACHE", 30)
    monkeypatch.setattr(quality, "SUM", 25)
    w = quality.Words(["a", "b"])
    text = " ".join(f"w{i}" for i in range(200)) + " a b a"
    one = quality.pooled(w, np.eye(2, quality.DIM, dtype=np.float32), text)
    want = np.zeros(2 * quality.DIM)
    for x in quality.words_of(text):
        places, signs = quality.index_vector(x)
        assert len(set(places)) == quality.NONZERO
        want[places] += signs
        want[quality.DIM + "ab".find(x)] += x in "ab"
    assert np.allclose(one, want / 203)
    assert quality.words_of("Ab ab ab! %%%x_1") == ["ab", quality.AGAIN, quality.AGAIN, "!", "%%%", "x_1"]


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "a " * 50_000), (None, "b")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    rows = [(i, ("fine words here " if i % 2 else "%%% ### ") * 9) for i in range(60)] + [(98, None), (99, "")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (98, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs_of(spark, rows), labels).collect()}
    assert len(got) == 62 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1]["score"] > got[2]["score"]
    twice = spark.createDataFrame([(i, t, "old", 9) for i, t in [*rows, rows[3], rows[3]]], "doc_id long, text string, score string, predicted int")
    again = quality.score(twice, quality.train(twice, labels))
    assert again.count() == 64 and again.filter("doc_id = 3").select("score").distinct().count() == 1 and dict(again.dtypes)["score"] == "double"
    assert quality.classify(docs_of(spark, []), labels).count() == 0 and quality.classify(docs_of(spark, []), none).count() == 0


def licenses_by_brute_force(text, templates):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    own, out = shingle(words(text)), set()
    for name, t in templates:
        s = shingle(words(t))
        if name and s:
            slack = -(-len(s) // 5) + 4
            for at in range(-len(s), len(own)):
                region = set(own[max(0, at - slack) : at + len(s) + slack + 1])
                if len(region & set(s)) >= 0.8 * len(set(s)):
                    out.add(name)
                    break
    return out


def test_license_scan_against_brute_force(spark):
    rng = random.Random(2)
    templates = [*license_scan.TEMPLATES, ("OWN", prose(rng, 80)), ("OWN", prose(rng, 9)), ("SIX", prose(rng, 10)), (None, prose(rng, 20)), ("VOID", None), ("VOID", "two words"), ("MIT", "Released under the MIT License.")]
    rows = [(0, None), (1, ""), (2, "Licensed under"), (3, "\n".join(t for _, t in license_scan.TEMPLATES)), (4, "Released under the MIT License. " * 3000), (None, templates[3][1]), (4, "Released under the MIT License. ")]
    for i in range(240):
        w = (rng.choice(templates)[1] or "none").split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, len(w) // 25, len(w) // 18))):  # words changed, added, taken out
            k = rng.randrange(len(w))
            w[k : k + rng.choice((0, 1, 1))] = rng.choice((["other"], ["other"], []))
            w = w or ["none"]
        if rng.random() < 0.3:
            w = w[rng.randrange(1 + len(w) // 4) :]
        rows.append((10 + i, f"{prose(rng, rng.randrange(60))} {' '.join(w)} {prose(rng, rng.randrange(60))}"))
    got = license_scan.scan(docs_of(spark, rows), license_scan.templates_table(spark, templates)).collect()
    want = Counter((i, name) for i, t in rows for name in licenses_by_brute_force(t, templates))
    assert Counter((r["doc_id"], r["license"]) for r in got) == want and len({n for _, n in want}) > 9
    by = {(r["doc_id"], r["license"]): r for r in got if r["doc_id"] != 4}
    assert by[None, "MIT"]["first_word"] == 0 and by[None, "MIT"]["containment"] == 1 and max(r["n_places"] for r in got if r["doc_id"] == 4) == 3000
    clash = spark.createDataFrame([(1, templates[3][1], 7, "x")], "doc_id long, text string, row int, license string")
    assert license_scan.scan(clash, license_scan.templates_table(spark, templates)).count() == 1
    assert license_scan.scan(docs_of(spark, []), license_scan.templates_table(spark)).count() == 0
    assert license_scan.scan(docs_of(spark, rows), license_scan.templates_table(spark, [])).count() == 0


def test_license_windows_collide_as_often_as_stated(spark):
    """Windows of four shingles of which half or three are shared meet in a band with the probability of the docstring, or more."""
    rows = [(i, [4 * i, 4 * i + 1, 4 * i + 2, 4 * i + 3], [4 * i, 4 * i + 1, -4 * i - 1, -4 * i - 2], [4 * i, 4 * i + 1, 4 * i + 2, -4 * i - 3]) for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>, c array<long>")
    low = [license_scan.minima_of(F.col(x)) for x in "abc"]
    got = df.select(F.arrays_overlap(low[0], low[1]).cast("int").alias("b"), F.arrays_overlap(low[0], low[2]).cast("int").alias("c")).agg(F.avg("b"), F.avg("c")).first()
    assert got[0] >= 1 - (1 - 2 / 6) ** license_scan.BANDS - 0.03 and got[1] >= 1 - (1 - 3 / 5) ** license_scan.BANDS - 0.02


def test_substring_dedup(spark):
    rng = random.Random(3)
    passage, two = prose(rng, 60), prose(rng, 30) + "\n\n" + prose(rng, 30)
    rows = [(1, f"a\n{passage}\nb"), (2, f"{passage.upper()}\nlast é"), (3, f"é\n{two}"), (4, f"x\n{two}\ny"), (5, prose(rng, 20)), (6, None), (7, ""), (8, prose(rng, 20)), (None, passage)]
    docs = docs_of(spark, rows)
    spans = substring_dedup.repeats(docs)
    got = sorted(tuple(r) for r in spans.select("doc_id", "start", "end", "words", "kept_doc_id", "kept_start").collect())
    assert got == [(2, 0, len(passage), 60, 1, 2), (4, 2, 2 + len(two), 60, 3, 2)]
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, spans).collect()}
    assert kept[2] == "last é" and kept[4] == "x\ny" and kept[1] == rows[0][1] and kept[6] is None
    assert substring_dedup.repeats(docs_of(spark, [])).count() == 0


def brute_runs(rows, size):
    """The words of each document that lie in a run of ``size`` words that occurs before."""
    first, hit = {}, defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        for j in range(len(w) - size + 1):
            d, k = first.setdefault(tuple(w[j : j + size]), (i, j))
            if d != i or j - k >= size:
                hit[i].update(range(j, j + size))
    return hit


def test_substring_dedup_within_lines(spark):
    rng = random.Random(13)
    a, b = prose(rng, 51), prose(rng, 70)
    rows = [(1, f"é {prose(rng, 9)} {a} {prose(rng, 8)}"), (2, f"{prose(rng, 5)}\n{prose(rng, 3)} {a.upper()}\n{prose(rng, 4)}"), (3, prose(rng, 200) + " " + b), (4, f"own {b} own"), (5, " ".join(b.split()[:50])), (6, "x " * 130)]
    rows += [(7, f"{prose(rng, 30)} {' '.join(b.split()[9:65])}"), (8, f"{prose(rng, 20)} {a}  {b} end"), (9, f"{b} between {prose(rng, 60)} {b}"), (None, a), (10, None), (4, f"own {b} own")]
    docs = docs_of(spark, rows)
    spans = substring_dedup.repeats(docs)
    got, texts = defaultdict(set), dict(rows)
    for r in spans.collect():
        before = len(texts[r["doc_id"]][: r["start"]].split())
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].split()) == r["words"] > 50
        got[r["doc_id"]].update(range(before, before + r["words"]))
    want = brute_runs([r for k, r in enumerate(rows) if r not in rows[:k]], 51)
    assert got == want and set(want) == {2, 4, 6, 7, 8, 9} and got[6] == set(range(51, 130))
    assert all(r["kept_doc_id"] == {2: 1, 4: 3, 6: 6, 7: 3, 8: 1, 9: 3}[r["doc_id"]] for r in spans.collect())
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, spans).collect()}
    assert kept[4] == "own own" and kept[2] == rows[1][1].replace(a.upper(), "") and kept[5] == rows[4][1]


def distance_in(item, text):
    prev = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        cur = [i]
        for j in range(1, len(text) + 1):
            cur.append(min(prev[j - 1] + (item[i - 1] != text[j - 1]), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_is_exact(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 12, 20, 30, 4, 7, 8))]
    m = decontam.Matcher([(i, decontam.fold(t)) for i, t in items])
    for n in range(98):
        i, t = items[n % 7]
        s = list(t)
        for _ in range(rng.randrange(decontam.budget(len(t)) + 4)):
            p = rng.randrange(len(s))
            s[p] = rng.choice(["", "q", s[p] + "z"])
        text = decontam.fold(prose(rng, 20) + "\n" + "".join(s) + " " + prose(rng, 20))
        far = distance_in(decontam.fold(t), text)
        found = [x for x in m.find([text]) if x[1] == i]
        assert bool(found) == (far <= decontam.budget(len(t))) and (not found or min(x[4] for x in found) == far)
    bench = spark.createDataFrame([*items, (8, None), (9, "short")], "item_id long, text string")
    docs = docs_of(spark, [(1, "Zé " + items[1][1].upper() + "!"), (2, prose(rng, 90)), (3, None), (4, ""), (None, items[3][1])])
    got = sorted((tuple(r) for r in decontam.find(docs, bench).collect()), key=str)
    assert got == [(1, 1, 3, 3 + len(items[1][1]), 0), (None, 3, 0, len(items[3][1]), 0)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [2, 3, 4]
    assert decontam.find(docs, bench.limit(0)).count() == 0 and decontam.clean(docs_of(spark, []), bench).count() == 0


def test_decontamination_of_short_equal_and_many_items(spark, monkeypatch):
    rng = random.Random(15)
    long = prose(rng, 25)
    bench = [(1, "Zeta 5?"), (2, "zeta 5?"), (3, long), (4, long), (5, None), (6, " \n "), (7, "a" * 30), (8, "ü")]
    bench += [(100 + i, prose(rng, 12)) for i in range(40)]
    rows = [(1, "is ZETA 5? so"), (2, "azeta 5?"), (3, prose(rng, 60_000) + " " + long), (4, "a" * 3000), (5, "über"), (6, "x ü."), (1, "is ZETA 5? so"), (7, bench[20][1])]
    want = {(1, 1), (1, 2), (3, 3), (3, 4), (6, 8), (4, 7), (7, bench[20][0])}
    table = spark.createDataFrame(bench, "item_id long, text string")
    for size, expand in ((2 << 20, 1 << 20), (700, 50)):  # one block; several, and a few hits at a time
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontam, "EXPAND", expand)
        got = decontam.find(docs_of(spark, rows), table).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        assert Counter((r["doc_id"], r["item_id"]) for r in got)[1, 1] == 2 and Counter((r["doc_id"], r["item_id"]) for r in got)[4, 7] == 100
        assert sorted(r["doc_id"] for r in decontam.clean(docs_of(spark, rows), table).collect()) == [2, 5]


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    vectors = [base[i % 40] + rng.normal(size=16) * (0.02, 0.06, 0.3)[i % 3] for i in range(600)]
    rows = [(i, v.astype(np.float32).tolist(), i % 2, "x") for i, v in enumerate(vectors)]
    rows += [(600 + i, rows[4][1], 0, "x") for i in range(5)]
    odd = [(700, None, 0, "x"), (701, [0.0] * 16, 0, "x"), (702, [float("nan")] * 16, 0, "x"), (703, [None] * 16, 0, "x"), (704, rows[4][1], None, "x"), (705, rows[4][1][:8], 0, "x"), (706, [], 0, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, component_id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw_dedup.dedup(df, shard_size=150).collect()}
    v = hnsw_dedup._unit(np.array([r[1] for r in rows], np.float32))
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = union_find(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    found, real = sum(got[i][0] for i in ids), int(near.sum())
    assert 0.99 * real <= found <= real
    assert np.mean([got[i][1] == want[i] for i in ids]) > 0.99 and all(got[i][2] == (got[i][1] == i) for i in ids)
    assert all(got[i[0]] == (0, i[0], True) for i in odd)
    assert hnsw_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_dedup_of_large_labels(spark):
    """Labels of thousands, searched through their graphs: two shards of one label and one of another, against brute force."""
    rng = np.random.default_rng(16)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    big = [base[i % 1500] + rng.normal(size=24) * 0.02 for i in range(5200)] + [base[7] + rng.normal(size=24) * 0.01 for _ in range(300)]
    other = [base[i % 1500] + rng.normal(size=24) * 0.02 for i in range(700)]
    vectors = np.array(big + other)
    label = np.array(["p"] * len(big) + ["q"] * len(other))
    df = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(vectors, label.tolist(), strict=True))], "vec_id long, embedding array<double>, label string")
    rows, audits = hnsw_dedup.audited(df, shard_size=3000)
    got = rows.toPandas().set_index("vec_id").sort_index()
    v = hnsw_dedup._unit(vectors)
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = union_find(range(len(v)), zip(*np.nonzero(near), strict=True))
    assert 0.99 * near.sum() <= got["n_links"].sum() <= near.sum() and (got["n_links"].to_numpy() <= near.sum(1)).all()
    assert np.mean([got.component_id[i] == want[i] for i in range(len(v))]) > 0.995
    told = audits.toPandas()
    assert len(told) == 5 and (told["width"] < 1000).all() and (told["found"] >= 0.999 * told["there"]).all() and told["there"].sum() > 0


def test_embedding_dedup_of_odd_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 0), (None, v, 0), (4, v, 0), (4, v, 0), (2, v, 0), (5, [float("inf"), 1.0, 1.0], 0), (6, [-float("inf"), 1.0, 1.0], 0), (7, [2e200, 4e200, 6e200], 0)]
    got = sorted((tuple(r) for r in hnsw_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(None, 0, None, True)] * 2 + [(4, 3, 2, False)] * 2 + [(2, 3, 2, True), (5, 0, 5, True), (6, 0, 6, True), (7, 3, 2, False)], key=str)


def test_graph_recall():
    v = hnsw_dedup._unit(np.random.default_rng(7).normal(size=(1500, 24))).astype(np.float32)
    g, order = hnsw_dedup.Graph.build(v)
    assert len(g.links) > 1
    q = v[:200]
    ids, _ = g.search(q, 64)
    near = np.argsort(-(q @ g.vectors.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(ids, near, strict=True)]) >= 0.9
    back, more = hnsw_dedup.Graph.unpack(g.pack(rep=order))
    assert (back.search(q, 64)[0] == ids).all() and (more["rep"] == order).all()


def json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    t = json_tokenizer()
    texts = ["", " ", "  ", "a  b", "a   b", "a \n b", "a\n b", " a", "a ", "\n", "a\n\nb c.d,e", "it's 's 'tis", "a\n \nb", "tab\t b", "é ü 12 3.5%.\n%", "<|endoftext|> x", " x   y", "a\x0b b", "日本 語。 ok", "x" * 5000, "Ö. a\r\n b"]
    texts += [prose(random.Random(i), 50) + ".\n" + prose(random.Random(i), 9).title() for i in range(20)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    coder = packing.ChunkEncoder(packing.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in coder.encode_all(texts)] == want
    coder._clear()
    coder.values[:] = np.uint64(1)  # hashes that collide all the time: the comparison of bytes has to notice
    for _ in range(2):
        assert [x.tolist() for x in coder.encode_all(texts)] == want
    monkeypatch.setattr(packing, "CACHE", 40)  # a table that is full all the time
    coder = packing.ChunkEncoder(packing.default_tokenizer())
    assert [x.tolist() for t in texts for x in coder.encode_all([t])] == want


def test_pieces_give_added_tokens_their_ids(spark):
    t = json_tokenizer()
    texts = ["<|endoftext|>", "a b. <|endoftext|> c\nd", "x<|endoftext|><|endoftext|>\u00a0y", "<|endoftext", "<|endof\ntext|> z", "plain words, here."]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pieces(docs_of(spark, list(enumerate(texts))), packing.default_tokenizer()).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert got[0] == [50256, 2]


def fewest_bins(items, capacity):
    """The optimum of a small instance, by trying every bin for every piece."""
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(items) or len(rooms) > best:
            return
        if i == len(items):
            best = min(best, len(rooms))
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(21)
    sizes = Counter()
    for _ in range(400):
        c = rng.choice((20, 30, 50))
        items = sorted((rng.randint(max(1, c // 6), c) for _ in range(rng.randint(1, 10))), reverse=True)
        fixed, left = packing.reduce_instance(Counter(items), c)
        assert Counter(s for held, k in fixed for s in held for _ in range(k)) + Counter(left) == Counter(items)
        sizes.update(len(held) for held, _ in fixed)
        rest = [s for s, n in left.items() for _ in range(n)]
        best = fewest_bins(items, c)
        assert sum(k for _, k in fixed) + fewest_bins(sorted(rest, reverse=True), c) == best
        assert packing.lower_bound(Counter(items), c) <= best <= sum(k for _, k in packing.plan(Counter(items), c))
    assert sizes[1] and sizes[2] and sizes[3]
    assert packing.reduce_instance({60: 1, 25: 1, 14: 1, 8: 1, 39: 1}, 100)[0] == [((60, 39), 1), ((25, 14, 8), 1)]


def test_packing_query_against_the_plain_tokenizer(spark, sf):
    """The contract's columns worked out with the tokenizer itself, and how far the packing is from the lower bound."""
    t = json_tokenizer()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k] = (i, j - i, zlib.crc32(ids[i:j].tobytes()))
    got = queries.op9_packing(spark, sf).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
    least = packing.lower_bound(Counter(got["length"].tolist()), 1024)
    assert got["sequence_id"].nunique() <= least + max(1, least // 500)


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(i, 10 + i % 7, i * 2, "b", i, -1, -2) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, length long, base long, cell string, nth int, sequence_id int, offset int")
    got = packing.pack(df, 64)
    assert got.columns == ["doc_id", "length", "base", "cell", "nth", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == [r[:5] for r in rows] and got.filter("sequence_id < 0").count() == 0


def test_plans_hold_every_piece_once():
    rng = np.random.default_rng(8)
    for _ in range(60):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 300)).tolist())
        held = Counter()
        bins = 0
        for lengths, k in packing.plan(counts, 100):
            assert sum(lengths) <= 100 and k > 0
            bins += k
            for s in lengths:
                held[s] += k
        assert held == counts
        least = -(-sum(s * n for s, n in counts.items()) // 100)
        assert bins <= max(least + 2, 1.25 * least)
    fixed, left = packing.reduce_instance({70: 2, 30: 1, 29: 1, 95: 3}, 100)
    assert sorted(fixed) == [((70, 29), 1), ((70, 30), 1), ((95,), 3)] and not left
    assert not packing.plan({}, 100) and packing.lower_bound({}, 100) == 0


def test_packing_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 900))) for i in range(40)] + [(50, None), (51, ""), (52, prose(rng, 3)), (53, prose(rng, 3)), (None, "x"), (50, None)]
    got = packing.pack_documents(docs_of(spark, rows), packing.default_tokenizer(), 256).toPandas()
    coder = packing.ChunkEncoder(packing.default_tokenizer())
    got = got[got["doc_id"].notna()]
    for doc, p in got[got["doc_id"] != 50].groupby("doc_id"):
        p = p.sort_values("piece")
        text = next(t for i, t in rows if i == doc) or ""
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in p["ids"]])
        assert ids.tolist() == [*coder.encode_all([text])[0].tolist(), 2]
        assert p["start"].tolist() == np.concatenate([[0], p["length"].cumsum()[:-1]]).tolist() and (p["length"].iloc[1:] == 256).all()
    for _, s in packing.pack_documents(docs_of(spark, rows), packing.default_tokenizer(), 256).toPandas().groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == np.concatenate([[0], s["length"].cumsum()[:-1]]).tolist() and s["length"].sum() <= 256
    assert packing.pack_documents(docs_of(spark, []), packing.default_tokenizer()).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "x" * 300_000, "<p>é</p>", "same", "same", "a\r\n\r\nb"]
    rows = [(i, f"http://h/{i}\r\n x", h, "z") for i, h in enumerate(html)] + [(None, None, "same", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.archive(pages, payloads=True).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        data, r = (h or "").encode(), got[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["valid"]
        keep = last[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
        assert keep != i or bytes(r["payload"]) == data
    assert got[None]["record_type"] == "revisit" and got[None]["refers_to"] == 6
    assert warc.archive(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "p"), (1, "u", "p"), (2, "u", "p"), (2, "v", "p"), (2, "u", "q"), (1, "u", "q"), (3, "u", None)], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["valid"]) for r in warc.archive(twice).collect())
    assert got == {(1, 1, "revisit", 2, True): 3, (2, 1, "response", None, True): 3, (3, 0, "response", None, True): 1}
    assert warc.archive(twice, min_bytes=2).filter("record_type = 'revisit'").count() == 0


def test_warc_revisits_are_checked_against_their_response(spark):
    rows = [(1, "response", None, "A", True), (2, "revisit", 1, "A", True), (3, "revisit", 1, "B", True), (4, "revisit", 9, "A", True), (5, "response", None, "C", False), (6, "revisit", 5, "C", True), (7, "response", None, "D", False)]
    got = warc.checked(spark.createDataFrame(rows, "page_id long, record_type string, refers_to long, payload_digest string, valid boolean"))
    assert {r["page_id"]: r["valid"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_warc_reader_finds_faults():
    def member(data):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    good = member(warc.record(1, "u", b"hello", None)) + member(warc.record(2, "u", b"hello", 1))
    assert [(r["length"], r["valid"]) for r in warc.records(io.BytesIO(good).read, True)] == [(5, True), (5, True)]
    spoiled = member(warc.record(1, "u", b"hello", None).replace(b"hello", b"jello"))
    assert not next(iter(warc.records(io.BytesIO(spoiled).read)))["valid"]
    for bad in (good[:-9], member(b"nothing"), member(warc.record(1, "u", b"hello", None) + b"x")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad).read))


SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(name, spark, sf, duck):
    df = queries.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(want.fetchall(), list(want.columns))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, sf).cache()
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= set(before)
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert kept[3] == kept[4] and len(kept[2]) < len(kept[0])
    assert sorted(corpus_pipeline.run(spark, sf).columns) == sorted(docs.columns)


def edits_from(item: bytes, texts: list[bytes]) -> np.ndarray:
    """Edit distance of item to the nearest passage of each text, by dynamic programming over all texts at once."""
    gap = np.full(len(item) + 1, 256)  # wider than any budget, so no passage reaches over it
    b = np.concatenate([x for t in texts for x in (np.frombuffer(t, np.uint8).astype(int), gap)])
    row = np.zeros(len(b) + 1, int)
    at = np.arange(len(b) + 1)
    for c in item:
        new = np.minimum(row + 1, np.concatenate([[len(item)], row[:-1] + (b != c)]))
        row = np.minimum.accumulate(new - at) + at
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    return np.array([row[e - len(t) - len(gap) : e - len(gap) + 1].min() for t, e in zip(texts, ends, strict=True)])


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    rows: dict = {}
    items = [(i, prose(rng, 20)) for i in range(5)] + [(9, None)]
    common = [f"{LONG}{prose(rng, 6)}" for _ in range(4)]
    for i in range(240):
        t = prose(rng, rng.randrange(30, 120)) + "."
        if i % 6 == 5:
            t = "".join(f"{w}%%% " for w in t.split())
        elif i % 6 == 1:
            t += "\n" + common[i % 4]
        elif i % 24 == 2:
            t = rows[i - 2].replace(" ", "  ", 1)
        elif i % 24 == 8:
            t += " " + items[i % 5][1].upper()[:-2] + "zz"
        rows[i] = t
    rows |= {300: None, 301: "", 302: " \n ", 303: common[1], 304: "x " + prose(rng, 9000), 305: "%%% " * 4000, 306: common[1]}
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()] + [(0, rows[0], "en", "s", len(rows[0])), (None, rows[3], None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 6 != 5), 0) for i in range(0, 240) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = [(r["doc_id"], r["text"]) for r in given.collect()]

    def step(name):
        nonlocal given
        given = stages[name](spark, given, str(tmp_path)).cache()
        if name != "best_fit_packing":
            assert given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return sorted(((r["doc_id"], r["text"]) for r in given.collect()), key=str)

    learn = [(i, rows[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    m = quality.fit([t for _, t, _ in learn], np.array([y for _, _, y in learn]), [i for i, _, _ in learn])
    words = quality.Words(m.vocabulary)
    kept = [(i, t) for i, t in order if m.score(quality.pooled(words, m.context, t)[None])[0] >= 0.7]
    assert step("quality_classifier") == sorted(kept, key=str)
    assert not any(i in rows and i % 6 == 5 and i < 240 for i, _ in kept if i is not None) and sum(1 for i, _ in kept if i is not None and i % 6 != 5 and i < 240) >= 198

    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, t in kept:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holds[key(line)].add(i)
    lines = []
    for i, t in kept:
        own = (t or "").split("\n")
        left = [x for x in own if i is None or len(holds[key(x)]) < 5 or i == max(holds[key(x)])]
        if len(left) == len(own) or "".join(left).strip():
            lines.append((i, "\n".join(left)))
    assert step("line_dedup") == sorted(lines, key=str) and len(lines) < len(kept)
    assert given.filter(F.length("text") != F.col("n_chars")).count() == 0

    sets = {}
    for i, t in lines:
        w = key(t).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(ids, links)
    first = [(i, t) for i, t in lines if i is None or root[i] == i]
    assert step("ngram_jaccard_join") == sorted(first, key=str) and len(links) > 3

    texts = [decontam.fold(t) for _, t in first]
    leaks = np.zeros(len(first), bool)
    for _, t in items[:5]:
        leaks |= edits_from(decontam.fold(t), texts) <= decontam.budget(len(t))
    clean = [x for x, bad in zip(first, leaks, strict=True) if not bad]
    assert step("benchmark_decontamination") == sorted(clean, key=str) and 5 < leaks.sum() < 20

    packed = stages["best_fit_packing"](spark, given, str(tmp_path)).toPandas()
    t, want = json_tokenizer(), Counter()
    for i, text in clean:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in packed[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()) == want
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
    assert packed["sequence_id"].nunique() <= packing.lower_bound(Counter(packed["length"].tolist()), 1024) + 1


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_gives_extra_columns_back(spark, sf):
    """Columns named like those that the stages make pass through; a table without n_chars does as well."""
    import corpus_pipeline

    extra = {"score": "concat('s', doc_id)", "Predicted": "doc_id + 1", "n_lines": "doc_id + 2", "n_dropped": "concat('d', doc_id)", "first_doc": "doc_id + 3", "lost_keys": "doc_id + 4", "item_id": "doc_id + 5"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mine = docs.drop("n_chars").selectExpr("*", *[f"{e} AS `{c}`" for c, e in extra.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, sf).collect()}
        out = stage(spark, mine, sf)
        assert out.columns == mine.columns and out.schema == mine.schema
        got = out.selectExpr("doc_id", "text", *[f"`{c}` = {e} AS ok_{i}" for i, (c, e) in enumerate(extra.items())]).collect()
        assert {r["doc_id"]: r["text"] for r in got} == plain and all(all(r[2:]) for r in got)
