"""Operators of training-data pipelines against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import arrays, katz, kdshards, mixing, neighbours, registry, simhash, suffixes, templates, tokenfiles, toxicity, urlfilter
from tidemark.llm.common import Scratch, ships_package, table
from tidemark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ship(spark):
    ships_package(lambda s: None)(spark)


@pytest.fixture(scope="module")
def docs(spark, ship):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def local(docs):
    return sorted(docs.select("doc_id", "text", "source").collect())


@pytest.fixture(scope="module")
def odd(spark, ship):
    """Nulls, empty and long texts, ties, repeated rows and columns that operators use as names."""
    long = " ".join(f"w{i % 5000} the" for i in range(20000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "  \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, long, "de", "b", len(long)), (6, "same text here of five words", "en", "a", 5), (7, "same text here of five words", "en", "a", 5), (7, "same text here of five words", "en", "a", 5), (None, "no id at all", "en", "c", 3), (8, "snow ☃ \U0001f600 中文", "zh", "c", 9)]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark, ship):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- op 1 ----


def brute_katz(rows):
    train = [not katz.is_held_out(i) for i, _ in rows]
    texts = [[*WORD.findall(lower(t)), None] for _, t in rows]
    uni, bi = Counter(), Counter()
    for ok, ws in zip(train, texts, strict=True):
        if ok:
            uni.update(ws)
            bi.update(zip(["<s>", *ws], ws, strict=False))
    n, v = sum(uni.values()), len(uni)
    n_r = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
    d1, d2 = katz.discounts(n_r(uni)), katz.discounts(n_r(bi))
    f = lambda d, c: d[c] if c <= katz.CUT else 1.0
    free = 1 - sum(f(d1, c) * c for c in uni.values()) / n
    p1 = lambda w: f(d1, uni[w]) * uni[w] / n if uni[w] else free
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        total = sum(seen.values())
        left = sum((1 - f(d2, c)) * c for c in seen.values())
        stuck = left <= 1e-12
        if w in seen:
            return seen[w] / (total + 1) if stuck else f(d2, seen[w]) * seen[w] / total
        return (1 / (total + 1) if stuck else left / total) / (1 - sum(p1(x) for x in seen)) * p1(w)

    for h in list(after)[:20]:  # exactly normalised, with one unknown word
        assert sum(p2(h, w) for w in uni) + p2(h, "<never>") == pytest.approx(1, abs=1e-9)
    out = []
    for (i, _), ok, ws in zip(rows, train, texts, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ws], ws, strict=False))
        out.append((i, not ok, len(ws), sum(uni[w] > 0 for w in ws), n, base, score))
    return out


def test_katz(spark, docs, local):
    got = sorted(katz.katz_scores(docs, spark).collect())
    for g, w in zip(got, brute_katz([(i, t) for i, t, _ in local]), strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-7)


def test_katz_tells_long_words_apart(spark, ship):
    word = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    held = next(i for i in range(99) if katz.is_held_out(i))
    rows = [(held, f"{word} {other}"), *((i, word) for i in range(100, 140) if not katz.is_held_out(i))]
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark).where("held_out").collect()
    assert [r.n_known for r in got] == [2] and got[0].n_tokens == 3


def test_katz_odd(spark, odd, empty):
    got = katz.katz_scores(odd, spark).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and all(math.isfinite(r.score) for r in got)
    assert katz.katz_scores(empty, spark).count() == 0
    assert katz.katz_scores(odd.where("doc_id = 999"), spark).count() == 0


# ---- op 2 ----


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(s))


def components(prints, ids):
    u = np.unique(np.array(prints, np.uint64))
    root = {int(x): int(x) for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4):
            root[find(int(u[i]))] = find(int(u[i + 1 + j]))
    least = {}
    for p, i in zip(prints, ids, strict=True):
        least[find(p)] = min(least.get(find(p), i), i)
    return [least[find(p)] for p in prints]


def test_components_with_hot_nodes(spark, ship):
    r = np.random.default_rng(3)
    edges = [(int(a) // 600, 5000 + int(b)) for a, b in r.integers(0, 3000, (3000, 2))] + [(9000 + i, 9001 + i) for i in range(40)] + [(None, 3), (4, 4), (7, 6), (7, 6)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    assert {x.node: x.root for x in got} == {x: find(x) for x in root}


@pytest.mark.parametrize("dump", [arrays.dump, arrays.dump_planes])
def test_arrays(dump):
    r = np.random.default_rng(0)
    given = {"none": np.zeros(0, np.int64), "wide": r.integers(-(9**9), 9**9, 999), "byte": np.arange(255, dtype=np.uint8), "flag": r.random(50) > 0.5, "real": r.random(33), "one": np.array(7)}
    got = arrays.load(dump(**given))
    assert list(got) == list(given) and all(got[k].dtype == x.dtype and got[k].shape == x.shape and np.array_equal(got[k], x) for k, x in given.items())
    assert arrays.load(dump()) == {}


def test_simhash(spark, local):
    got = sorted(registry.queries()["op2_simhash"](spark, SF).collect())
    prints = [brute_fingerprint(t) for _, t, _ in local]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == components(prints, [i for i, _, _ in local])


def test_simhash_links_in_hot_keys(spark, ship, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)  # so that tiles are used
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    f = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 63, 60, dtype=np.uint64)) for b in base] + [r.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in f.view(np.int64)], "node long, f0 long")
    from tidemark.llm.common import Scratch
    from tidemark.llm.components import connected_components

    want = components([int(x) for x in f], list(range(len(f))))
    pair = lambda a: {i: frozenset(np.flatnonzero(np.array(a) == a[i]).tolist()) for i in range(len(a))}
    for choose in (2, 4):  # keys of few and of many fingerprints
        scratch = Scratch(spark)
        roots = dict(connected_components(simhash.links(nodes, 1, 4 + choose, choose, 4, scratch), scratch).distinct().collect())
        assert pair([roots.get(int(x), int(x)) for x in f.view(np.int64)]) == pair(want)


def test_simhash_odd(spark, odd, empty):
    got = simhash.near_duplicate_groups(odd, spark).collect()
    assert len(got) == 10 and {r.group_id for r in got if r.id in (1, 2, 3)} == {1} and {r.group_id for r in got if r.id in (6, 7)} == {6}
    assert simhash.near_duplicate_groups(empty, spark).count() == 0
    kept = simhash.near_duplicate_stage(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8]
    assert simhash.near_duplicate_stage(spark, empty, SF).count() == 0


def near_pairs(spark, texts):
    from itertools import combinations

    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if 4 * max(len(sets[i]), len(sets[j])) > 5 * min(len(sets[i]), len(sets[j])):
            continue
        if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in range(len(texts))}


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.near_duplicate_stage(spark, df, SF).collect()}


def test_near_duplicate_stage_misses_few_pairs(spark, ship):
    r = np.random.default_rng(11)
    texts = []
    for k in range(200):  # pairs of Jaccard 0.78 to 0.82: edits far apart kill five shingles each
        w = [f"w{x}" for x in r.integers(0, 10**6, 300)]
        v = list(w)
        for p in range(6): v[20 + 45 * p] = "edit"  # noqa: E701
        if k % 3 == 0: v[295] = "edit"  # noqa: E701
        texts += [" ".join(w), " ".join(v)]
    texts += [" ".join(["common words in a row here"] * 3 + [f"x{k % 4}{j}" for j in range(40)] + [f"y{k}"]) for k in range(40)]
    want, got = near_pairs(spark, texts), kept_of(spark, texts)
    assert want <= got and len(got - want) <= 0.1 * (len(texts) - len(want))


def test_near_duplicate_stage_on_all_pairs(spark, ship):
    d = "/root/testdata/sf0.01"
    rows = sorted(table(spark, d, "documents").select("doc_id", "text").collect())
    got = {r.doc_id for r in simhash.near_duplicate_stage(spark, table(spark, d, "documents"), d).collect()}
    assert got == {rows[i].doc_id for i in near_pairs(spark, [t for _, t in rows])}


def test_near_duplicate_stage_in_tiles(spark, ship, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    r, texts = np.random.default_rng(13), []
    for base in range(3):
        w = [f"b{base}w{x}" for x in range(200)]
        for _ in range(40):
            v = list(w)
            for p in r.integers(0, 200, r.integers(0, 4)): v[p] = f"e{r.integers(0, 10**6)}"  # noqa: E701
            texts.append(" ".join(v))
    assert kept_of(spark, texts) == near_pairs(spark, texts)


def test_near_duplicate_stage_keeps_what_is_not_near(spark, ship):
    r = np.random.default_rng(12)
    line = " ".join(f"line{j}" for j in range(14)) + " "
    texts = [line * 10 + " ".join(f"w{x}" for x in r.integers(0, 10**6, 50)) for _ in range(20)]  # one line repeated
    for _ in range(60):  # Jaccard 0.7 to 0.78
        w = [f"w{x}" for x in r.integers(0, 10**6, 300)]
        v = list(w)
        for p in range(r.integers(8, 11)): v[20 + 28 * p] = "edit"  # noqa: E701
        texts += [" ".join(w), " ".join(v)]
    assert kept_of(spark, texts) == near_pairs(spark, texts) == set(range(len(texts)))


# ---- op 3 ----


def brute_removed(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            if first.get(w, i) < i:
                gone[j : j + 50] = b"\1" * 50
            first.setdefault(w, i)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def check_suffixes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed(rows)
    got = suffixes.earlier_strings_removed(df, spark).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r


def test_suffixes(spark, local):
    check_suffixes(spark, [(i, t) for i, t, _ in local])


def test_suffixes_periodic_edges_and_edits(spark, ship, monkeypatch):
    r = np.random.default_rng(5)
    passage = "".join(r.choice(list("abcdefgh "), 400))
    rows = [(0, "ab" * 200), (1, "x" + "ab" * 40 + "y"), (2, "a" * 300), (3, "b" + "a" * 49), (4, "a" * 50), (5, passage), (6, passage[:49]), (7, passage[:50]), (8, "é" * 60), (9, "zé" + "é" * 25), (10, ""), (11, None)]
    for i in range(12, 60):
        t = list(passage[r.integers(0, 100) : r.integers(150, 400)])
        for _ in range(r.integers(0, 5)):
            t[r.integers(0, len(t))] = "#"
        rows.append((i, "".join(r.choice(list("pqrst"), 20)) + "".join(t)))
    monkeypatch.setattr(suffixes, "CHUNK_CHARS", 700)
    check_suffixes(spark, rows)


def test_suffixes_odd(spark, odd, empty):
    got = suffixes.earlier_strings_removed(odd, spark).collect()
    assert len(got) == 10 and all(r.n_removed == 0 for r in got if r.doc_id != 5)
    assert suffixes.earlier_strings_removed(empty, spark).count() == 0


# ---- op 4 ----


def test_blocks_round_trip():
    r = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), r.integers(0, 50257, 1000).astype(np.uint32), np.full(300, 9, np.uint32), np.where(r.random(5000) < 0.03, 2**32 - 1, r.integers(0, 9, 5000)).astype(np.uint32)):
        payload, starts = tokenfiles.encode_blocks(ids)
        assert (tokenfiles.decode_blocks(payload, starts, len(ids)) == ids).all()
        if len(ids) > 300:
            assert (tokenfiles.decode_blocks(payload, starts, 128, first_block=1) == ids[128:256]).all()


def library_rows(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenfiles.tokenizer_path()), 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokenfiles(spark, local):
    got = sorted(map(tuple, registry.queries()["op4_tokenfiles"](spark, SF).collect()))
    assert got == library_rows([(i, t) for i, t, _ in local])


def test_encoder_is_the_library():
    r = np.random.default_rng(3)
    parts = ["a", "b", "é", " ", " ", "\n", "\t", ".", "'s", "1", "²", "<|endoftext|>", "中", "  ", "\r\n", "don't", "\x1c", "\x85", "ª", "\0"]
    e = tokenfiles.Encoder(tokenfiles.tokenizer_path(), 50)
    texts = ["".join(r.choice(parts, r.integers(0, 14))) for _ in range(1500)]
    for k in range(0, len(texts), 50):
        for t, got in zip(texts[k : k + 50], e.encode(texts[k : k + 50]), strict=True):
            assert got.tolist() == e.library.encode(t, add_special_tokens=False).ids, t


def test_tokenfiles_odd(spark, odd, empty):
    got = tokenfiles.token_files(odd, spark).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and min(got, key=lambda r: r.start).doc_id is None
    assert tokenfiles.token_files(empty, spark).count() == 0


# ---- op 5 ----


def test_urls(spark, ship):
    link = '<link rel="canonical" href="{}">'
    go = '<META http-equiv=refresh content="0; URL=\'{}\'">'
    pages = [
        (1, "http://A.Example.org/es/1?x#y", None), (2, "https://b.net/p", link.format("http://a.example.org/es/1?x")), (3, "https://c.net", go.format("https://b.net/p")),
        (4, "http://x.com/de/1", ""), (5, "http://y.com/fr/9", ""), (6, "http://z.net/q", link.format("//y.com/fr/9")), (7, "http://z.net/r", go.format("/q")), (8, "http://w.net/", go.format("http://x.com/de/1")),
        (9, "http://w.net/", ""), (10, None, link.format("http://x.com/de/1")), (11, "no scheme", ""), (12, "http://example.org/en/12", ""), (13, "http://notexample.org/es/", ""), (14, "http://z.net/q", ""), (15, "http://q.net/a", go.format("http://gone.com/de/z")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, spark).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[12][2:] == ("example.org/en/1", "block") and got[13][2:] == ("org/", "allow")
    assert [got[i][2:] for i in (2, 3)] == [(None, "block")] * 2  # through a redirect to a canonical link
    assert got[4][3] == "block" and got[5][2:] == ("com/fr/", "allow") and got[6][3] == got[7][3] == "allow"
    assert got[8] == got[9] == ("w.net", "/", None, "block") and got[10] == ("", "", None, "allow") == got[11] and got[14][3] == "allow" and got[15][3] == "block"
    redirects = spark.createDataFrame([("http://x.com/de/1", "http://y.com/fr/9")], "src string, dst string")
    both = {r.page_id: r.verdict for r in urlfilter.judge(df, spark, redirects=redirects).collect()}
    assert both[8] == "allow" and both[4] == "block"  # allow goes before block among aliases; a rule before both
    assert urlfilter.judge(df.limit(0), spark).count() == 0 and urlfilter.judge(df, spark, rules=()).where("verdict = 'block'").count() == 0


def test_urls_on_random_links(spark, ship):
    """Chains, cycles and mixed components against the SQL and against a search over links."""
    r = np.random.default_rng(8)
    hosts = ["a.org", "example.org", "b.com", "c.net", "D.Net", "x.example.org"]
    urls = [f"http://{hosts[r.integers(0, 6)]}/{('es', 'en', 'fr', 'de', 'q')[r.integers(0, 5)]}/{r.integers(0, 20)}" for _ in range(300)]
    rows, edges = [], []
    for i, u in enumerate(urls):
        to = urls[r.integers(0, 300)] if r.random() < 0.45 else None
        form = ('<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0;url={}'>")[i % 2]
        rows.append((i, u if i % 50 else None, form.format(to) if to else "<p>canonical</p>"))
        if to and i % 50:
            edges.append((u, to))
    rows += [(300, "no scheme", None), (301, "HTTP://C.net#f", '<link rel=canonical href="/de/1">'), (302, "http://c.net/", None)]
    edges += [("http://c.net/", "http://c.net/de/1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(x) for x in urlfilter.judge(df, spark).drop("url").collect())
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    names = "page_id, host, path, rule, verdict"
    assert got == sorted(con.sql(f"select {names} from ({urlfilter.OP5_SQL})").fetchall())

    low = lambda u: re.sub("://[^/]*", lambda m: m[0].lower(), u)
    rule = lambda u: max(((len(h + p), v == "allow") for v, h, p in urlfilter.RULES if re.fullmatch(rf"(.*\.)?{re.escape(h)}", u.split("/")[2]) and ("/" + u.split("/", 3)[3]).startswith(p)), default=None)
    near = defaultdict(set)
    for a, b in edges:
        near[low(a)].add(low(b)), near[low(b)].add(low(a))
    for page, url, _ in rows[:300]:
        if url:
            seen, todo = {low(url)}, [low(url)]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            own, alias = rule(low(url)), [x[1] for x in map(rule, seen) if x]
            want = own[1] if own else any(alias) if alias else True
            assert got[page][4] == ("allow" if want else "block"), url


# ---- op 6 ----


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-(v * w).sum(), i) for i, w in good if i != q)[:k]
            out |= {(q, n, i) for n, (_, i) in enumerate(near, 1)}
    return out


def test_nearest(spark, ship):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=16).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(60)] + [(500, None), (520, [0.0] * 16), (540, [math.nan] + [1.0] * 15), (560, [1.0] * 15 + [None]), (580, []), (600, [1.0, 2.0]), (None, [1.0] * 16), (620, [math.inf] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>")
    exact = [(x.vec_id, x.vec) for x in df.collect()]
    from pyspark.sql import functions as F

    got = neighbours.nearest(df, spark, F.col("vec_id") % 20 == 0, 20, query_rows=8, candidate_rows=64).collect()
    assert {(x.query_id, x["rank"], x.vec_id) for x in got} == brute_nearest(exact, 20)
    assert neighbours.nearest(df.limit(0), spark, F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), spark, F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2


def few_nearest(spark, rows, **kw):
    from pyspark.sql import functions as F

    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, vec array<double>"), spark, F.col("vec_id") % 20 == 0, **kw).collect()
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)]


def test_nearest_beside_a_repeated_id(spark, ship):
    got = few_nearest(spark, [(i, [1.0] * 4) for i in [20] * 21 + [5, 6, 7]])
    assert [x[1:3] for x in got[:21]] == [(1, 5)] * 21 and len(got) == 63


def test_nearest_at_the_ends_of_doubles(spark, ship):
    assert [x[2] for x in few_nearest(spark, [(0, [1e200, 1.0]), (1, [1e-200, 3.0]), (2, [2e-200, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0, 3.0])])] == [3, 1, 2]
    r = np.random.default_rng(7)
    rows = [(i, (r.normal(size=4) * 10.0 ** r.integers(-250, 250)).tolist()) for i in range(60)] + [(60, [5e-324, 0.0, 0.0, 0.0]), (61, [1.7e308] * 4)]
    want = set()
    with np.errstate(all="ignore"):
        for q, v in rows:
            if q % 20 == 0:
                scores = [(-reduce(lambda t, x: t + x[0] * x[1], zip(v, w, strict=True), 0.0), i) for i, w in rows if i != q]
                want |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if not math.isnan(x[0]))[:20], 1)}
    assert set(few_nearest(spark, rows, query_rows=2, candidate_rows=16)) == want


def test_nearest_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, registry.queries()["op6_nearest"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(con.sql(f"select query_id, rank, vec_id, score from ({neighbours.OP6_SQL})").fetchall())


# ---- op 7 ----


def test_templates(spark, ship, docs):
    item = "When the old market opens then Alice buys 12 red apples and some green pears for 3 dollars so how many coins does Alice pay in total?"
    same = "some words before. " + item.replace("Alice", "Bob").replace("12", "45").replace("3 dollars", "7 dollars") + " and after"
    mixed = item.replace("does Alice pay", "does Carol pay").replace("12", "45")  # one person became two
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "only four plain words", 0)], "item_id long, text string, hits int")
    rows = [(1, same), (2, "nothing of the kind is asked in this text about apples and markets"), (3, None), (4, ""), (5, item.upper().lower()), (6, "here are only four plain words indeed"), (None, same), (7, mixed)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.id, r.item_id): r for r in templates.contaminated(df, bench, spark).collect()}
    assert {(1, 1), (None, 1), (6, 4)} <= set(got) and not {k for k in got if k[0] in (2, 3, 4)} and not got[1, 1].exact
    assert (7, 1) not in got or got[7, 1].hits < got[1, 1].hits
    assert templates.contaminated(df.limit(0), bench, spark).count() == 0 and templates.contaminated(df, bench.limit(0), spark).count() == 0
    kept = templates.decontamination_stage(spark, docs, SF)
    assert 0 < kept.count() <= docs.count() and kept.columns == docs.columns


def test_templates_find_whole_items(spark, local):
    items = table(spark, SF, "benchmark").collect()
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op7_templates"](spark, SF).collect()}
    want = {(i, b.item_id) for i, t, _ in local for b in items if b.text and b.text in t}
    assert want <= got


def found_by(spark, items, texts):
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.id, r.item_id) for r in templates.contaminated(df, bench, spark).collect()}


def test_templates_with_few_literals(spark, ship):
    items = [(1, "What is 17 times 24?"), (2, "5 km 7 m 3 cm 12 kg 8 g 4 l 6 ml plus 9 lb"), (3, "Dann fragte Anna den Peter nach Berlin und Maria zeigte Karl 12 Karten von Hamburg")]
    texts = [f"Some words. {x} More words." for _, x in items] + ["Some words. What is 18 times 25? More", "so he said, What is 17 times 24? to me", "1 km 2 m 3 cm 4 kg 5 g 6 l 7 ml plus 8 lb"]
    texts += ["Dann fragte Eva den Hans nach Bremen und Clara zeigte Otto 15 Karten von Kassel"]
    assert found_by(spark, items, texts) == {(0, 1), (1, 2), (2, 3), (4, 1), (6, 3)}


def test_templates_parts_of_long_items(spark, ship):
    w = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    assert found_by(spark, [(1, " ".join(w))], ["before it " + " ".join(w[200:300]) + " after it", " ".join(w[200:212]), " ".join(w[480:])]) == {(0, 1), (2, 1)}


def test_templates_without_item_id(spark, ship):
    item = "when the old market opens then many people buy red apples and some green pears"
    assert found_by(spark, [(None, item), (None, "another question that nobody has ever asked in this place"), (3, item)], ["no", item]) == {(1, None), (1, 3)}


def test_templates_with_a_full_bit_map(spark, ship, docs, monkeypatch):
    bench = table(spark, SF, "benchmark")
    whole = sorted(map(tuple, templates.contaminated(docs, bench, spark).collect()))
    monkeypatch.setattr(templates, "MOST_BITS", 64)
    assert sorted(map(tuple, templates.contaminated(docs, bench, spark).collect())) == whole and whole


def test_templates_find_new_parameters(spark, ship):
    """Every item and further questions with all numbers, names and units replaced."""
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect() if r.text]
    ask = ("A train travels {} km in {} hours then {} km in {} hours and {} km in {} hour", "If Anna gives {} of her {} marbles to Peter and Peter loses {} how many marbles does Peter have now?", "the farm of Maria sells {} kg of apples for {} dollars each and {} kg of pears for {} dollars so what does she earn")
    new = [(10_000 + i, q.format(*range(11 + i, 11 + i + q.count("{}")))) for i, q in enumerate(ask * 5)]
    other = {"Anna": "Ulla", "Peter": "Karl", "Maria": "Greta", "km": "miles", "kg": "lbs", "dollars": "euros", "hours": "days"}
    swap = lambda t: " ".join(str(int(w) + 500) if w.isdigit() else other.get(w, w) for w in t.split(" "))
    everything = items + new
    got = found_by(spark, everything, ["an answer follows. " + swap(t) + " so it was" for _, t in everything] + ["please say: " + t for _, t in new])
    n = len(everything)
    assert {(n + k, i) for k, (i, _) in enumerate(new)} <= got  # verbatim
    assert sum((k, i) in got for k, (i, _) in enumerate(items)) == len(items)
    assert sum((len(items) + k, i) in got for k, (i, t) in enumerate(new) if "train" not in t) == 10  # of the train only numbers and units are left


def test_decontamination_stage_odd(spark, odd, empty):
    clash = odd.withColumns({c: odd.text for c in ("id", "item_id", "hits", "row", "h", "pos", "own", "item")})
    for frame in (odd, clash, empty):
        kept = templates.decontamination_stage(spark, frame, SF)
        assert kept.columns == frame.columns and sorted(map(str, kept.collect())) == sorted(map(str, frame.collect()))


# ---- op 8 ----


def test_mixing_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, registry.queries()["op8_mix"](spark, SF).select(*names).collect()))
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({mixing.OP8_SQL})").fetchall())


def test_mixing_caps(spark, ship, odd, empty):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["big"] * 500 + ["small"] * 3 + ["tiny"] * 2 + [None] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, spark).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(sizes.values())) and all(target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    assert sorted(map(tuple, mixing.mix(df.repartition(7), spark).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert len(mixing.mix(odd, spark).collect()) == 10 and mixing.mix(empty, spark).count() == 0
    staged = mixing.mixing_stage(spark, df, SF)
    assert staged.columns == df.columns and abs(sum(len(WORD.findall(r.text or "")) for r in staged.collect()) - sum(taken.values())) == 0


# ---- op 9 ----


def shard_bytes(rows):
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    return total


def test_shards(spark, ship):
    d = "/root/testdata/sf0.01"
    got = registry.queries()["op9_kdshards"](spark, d).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, d, "documents").collect()}
    where, group = defaultdict(set), Counter()
    for r in got:
        raw = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        where[raw].add(r.shard)
        group[raw] += r.size
    assert len(got) == len(texts) and all(len(s) == 1 for s in where.values())  # equal texts lie together
    total = shard_bytes(got)
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) <= 2 * max(group.values())
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(con.sql(f"select {', '.join(names)} from ({kdshards.OP9_SQL})").fetchall())


def test_shards_odd(spark, odd, empty, docs):
    got = kdshards.with_slots(kdshards.kd_shards(odd, spark, leaves=3), spark).collect()
    assert len(got) == 10 and {r.shard for r in got} <= {0, 1, 2} and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert kdshards.with_slots(kdshards.kd_shards(empty, spark, leaves=4), spark).count() == 0
    assert kdshards.kd_shards(odd.select("doc_id", "text"), spark, leaves=2).count() == 10
    by_bytes = shard_bytes(kdshards.kd_shards(docs, spark, target_bytes=60_000).collect())
    assert max(by_bytes.values()) < 120_000
    hot = spark.range(4000).selectExpr("id AS doc_id", "'the same text' AS text", "'s' AS source", "'en' AS lang")
    total = shard_bytes(kdshards.kd_shards(hot, spark, leaves=8).collect())  # one text with more than a leaf's share is cut
    assert len(total) == 8 and max(total.values()) < 1.1 * min(total.values())


# ---- op 10 ----


def test_toxicity_held_out(spark, ship):
    d = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    got = [r for r in registry.queries()["op10_toxicity"](spark, d).collect()]
    assert len(got) == table(spark, d, "documents").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    pos, neg = [r.score for r in held if marks[r.doc_id]], [r.score for r in held if not marks[r.doc_id]]
    a, b = np.array(pos)[:, None], np.array(neg)[None, :]
    assert np.mean((a > b) + (a == b) / 2) > 0.95


def test_nnpu_recovers_a_toxic_word():
    r = np.random.default_rng(6)
    p = [np.unique(np.append(r.integers(1, 500, 20), 7)).astype(np.uint64) for _ in range(300)]
    u = [np.unique(np.append(r.integers(8, 500, 20), [7] if k % 10 == 0 else [])).astype(np.uint64) for k in range(1000)]
    m = toxicity.fit_nnpu(p, u, 0.1)
    z = lambda d: 1 / (1 + np.exp(-(m.bias + m.weights[np.isin(m.words, d)].sum())))
    assert np.mean([z(d) for d in p]) > 0.6 and np.mean([z(d) for k, d in enumerate(u) if k % 10]) < 0.1


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, None), (6, 0), (8, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, spark)
    got = toxicity.scored(odd, model, spark, ("doc_id", "score"), "tox").collect()
    assert len(got) == 10 and all(0 <= r.tox <= 1 for r in got)
    none = toxicity.train(odd, labels.limit(0), spark)
    assert {r.tox for r in toxicity.scored(odd, none, spark, ("doc_id",), "tox").collect()} == {0.0}
    assert toxicity.scored(empty, toxicity.train(empty, labels, spark), spark, ("doc_id",), "tox").count() == 0
    clash = odd.withColumns({c: odd.text for c in ("text__", "score_", "size_", "taken_", "ka_", "kb_", "row_", "size", "taken", "nth", "o", "b", "s", "whole", "rest")})
    for frame in (odd, clash, clash.limit(0)):
        kept = toxicity.toxicity_stage(spark, frame, SF)
        assert kept.columns == frame.columns and sorted(map(str, kept.collect())) == sorted(map(str, frame.collect()))  # nothing toxic here
        mixed = mixing.mixing_stage(spark, frame, SF)
        assert mixed.columns == frame.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in frame.collect()}


def test_mixing_stage_takes_what_the_mix_says(spark, ship):
    rows = [(1, "same words here in a row", "a")] * 20 + [(i, "some other words", s) for i, s in enumerate("bbccc", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(r.taken for r in mixing.mix(df, spark).collect())
    assert sum(len(WORD.findall(r.text)) for r in mixing.mixing_stage(spark, df, SF).collect()) == want


# ---- pipeline ----


def test_pipeline(spark, ship):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    from tidemark.llm.common import Scratch

    scratch, counts = Scratch(spark), [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.put(stage(spark, docs, SF), str(k))
        counts.append(docs.count())
        if k < 3:
            assert docs.columns == before.columns and docs.join(before, before.columns, "left_anti").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[5] == counts[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
