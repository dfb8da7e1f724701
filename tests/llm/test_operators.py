"""The ten operators on small fixtures: brute force, round trips and the defined edge cases."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_text, imatch, jaccard_join, line_dedup, packing, parse_dedup, pii, quality, token_coder, token_files, tokens
from quire.llm import words as words_module
from quire.llm.common import checkpoint_dir

SCHEMA = "doc_id bigint, text string, source string, key bigint, n int, label int, part int"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Near and exact copies, repeated lines, nulls, empties, one word, a very long text and repeated rows; columns with clashing names."""
    rng = random.Random(7)
    base = [prose(rng.randint(20, 90), rng) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        for share in (0.02, 0.1, 0.2):
            w = t.split()
            for _ in range(max(1, int(share * len(w)))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    line = "\n".join(prose(6, rng) for _ in range(5))
    texts += [line + "\n" + prose(12, rng), prose(9, rng) + "\n" + line, line, base[0], base[0], "", None, "one", "ONE", "two words", "\n\n\n\n", prose(4000, rng), "a b c", "A b\tc", "b c d e", "a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (None, base[1]), (None, None), (-5, base[2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "src0", 1, 2, 3, 4) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


# 1


def test_pii_validates_links_and_keeps_formats(spark, none):
    text = "a.b1@mail.example.com 4041894974608795 4041-8949-7460-8795 4041894974608796 +1 (988) 555-2485 988-555-2485 70.1.2.3 300.1.1.1 2020-02-29 29.02.2020 2021-02-30 123-45-6789 666-45-6789 DE89 3704 0044 0532 0130 00 DE88370400440532013000"
    df = frame(spark, [(1, text), (2, "mail a.b1@mail.example.com!"), (3, None), (4, ""), (5, "no data " * 5000), (1, text)])
    got = {(r["doc_id"], r["text"]): r for r in pii.pseudonymise(df, "k").collect()}
    one = next(r for (d, _), r in got.items() if d == 1)
    old, new = text.split(), one["text"].split()
    assert len(got) == 5 and one["n_values"] == 10
    for same in ("4041894974608796", "300.1.1.1", "2021-02-30", "666-45-6789", "DE88370400440532013000"):
        assert same in new
    for gone in ("a.b1@mail.example.com", "4041894974608795", "70.1.2.3", "2020-02-29", "123-45-6789"):
        assert gone not in one["text"]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    assert [shape(a) for a in old if "." not in a or "@" in a] == [shape(a) for a in new if "." not in a or "@" in a]
    assert new[1] == new[2].replace("-", "")  # one card, two writings
    digits = [int(c) for c in new[1]][::-1]
    assert sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) == sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    iban = re.search(r"[A-Z]{2}\d{2}( \d{4}){4} \d{2}", one["text"])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"\d{4}-\d{2}-\d{2}", one["text"])[0] == "-".join(re.search(r"(\d{2})\.(\d{2})\.(\d{4})", one["text"]).group(3, 2, 1))
    two = next(r for (d, _), r in got.items() if d == 2)
    assert two["text"].split()[1] == new[0] + "!"
    assert (3, None) in got and (4, "") in got and (5, "no data " * 5000) in got
    assert pii.pseudonymise(none, "k").count() == 0 and "source" in pii.pseudonymise(none, "k").columns
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_pii_is_a_permutation(spark):
    ids = spark.range(20 * 30)
    made = ids.select(pii.feistel_number(F.col("id"), 20, 30, "k", "t").alias("x"), pii.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("y"))
    got = made.collect()
    assert sorted(r["x"] for r in got) == list(range(600)) and len({r["y"] for r in got}) == 600


# 2


def test_html_marked_article(spark):
    page = (
        "<!DOCTYPE html><head><title>no</title></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p><b>one</b>\n two<br>three<p>four"
        "<script>if (a<b) x()</script><div id=comments><p>c</p></div><form><input>f</form></article><aside>side</aside><footer>&copy; f"
    )
    df = spark.createDataFrame([(1, "http://h.example/x", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>cut <b"), (5, "u", "plain &lt;text")], "page_id bigint, url string, html string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    t = "T & x\n\none two three\n\nfour"
    assert got == Counter([(1, t, len(t)), (2, "", 0), (3, "", 0), (3, "", 0), (4, "cut", 3), (5, "plain <text", 11)])
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_unmarked_boilerplate_goes_by_host(spark):
    rng = random.Random(2)
    common = " ".join(f"c{i}" for i in range(15))
    own = [" ".join(f"w{k}{rng.randrange(9**6)}" for _ in range(20)) for k in range(6)]
    rows = [(k, f"https://A.example:80/p{k}", f"<div>{common}</div><p>{own[k]} {common}</p>") for k in range(5)] + [(9, "https://other.example/", f"<div>{common}</div><p>{own[5]}</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert {k: got[k] for k in range(5)} == {k: own[k] for k in range(5)}
    assert got[9] == common + "\n\n" + own[5]


def test_html_copies_and_quotations_stay(spark):
    rng = random.Random(3)
    own = [" ".join(f"w{k}{rng.randrange(9**6)}" for _ in range(60)) for k in range(8)]
    near = " ".join([*own[3].split()[:30], "printed", *own[3].split()[31:]])
    menu = " ".join(f"m{i}" for i in range(12))
    rows = [
        (0, "http://a/x", f"<p>{own[0]}</p>"), (1, "http://a/x#top", f"<p>{own[0]}</p>"), (2, "http://a/y", f"<div>{own[0]}</div>"),
        (3, "http://b/x", f"<p>{own[1]}</p>"), (4, "http://b/", f"<p>{' '.join(own[1].split()[:20])}</p><p>{own[2]}</p>"),
        (5, "http://c/x", f"<p>{own[3]}</p>"), (6, "http://c/x?print", f"<p>{near}</p>"), (7, "http://c/", f"<p>{' '.join(own[3].split()[:20])}</p><p>{own[4]}</p>"),
        *[(8 + k, f"http://d/{k}", f"<div>{menu}</div><p>{own[5 + k % 3]}</p>") for k in range(4)],
    ]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[k] for k in range(7)] == [own[0], own[0], own[0], own[1], " ".join(own[1].split()[:20]) + "\n\n" + own[2], own[3], near]
    assert got[7] == " ".join(own[3].split()[:20]) + "\n\n" + own[4]
    assert [got[8 + k] for k in range(4)] == [own[5], own[6], own[7], own[5]]


def test_suffix_order_is_that_of_sorted_suffixes():
    rng = random.Random(8)
    codes = np.array([rng.randint(0, 3) for _ in range(400)])
    order, rank = html_text.suffix_order(codes, 8)
    heads = [tuple(codes[i : i + 8].tolist()) for i in range(len(codes))]
    assert [heads[i] for i in order] == sorted(heads)
    assert all((rank[i] == rank[j]) == (heads[i] == heads[j]) for i in range(0, 400, 7) for j in range(400))


@pytest.mark.parametrize("shard", [400_000, 120])
def test_html_repeats_against_brute_force(spark, monkeypatch, shard):
    """Pages whose article and class names are stripped: what three different streams of a host share goes, whatever marks it."""
    monkeypatch.setattr(html_text, "SHARD", shard)
    rng = random.Random(21)
    rows, parts = [], []
    for host in range(3):
        top, foot = (" ".join(f"{x}{host}{rng.randrange(99)}" for _ in range(n)) for x, n in (("t", 11), ("f", 9)))
        for k in range(6 if host < 2 else 2):
            own = [" ".join(f"o{rng.randrange(9**5)}" for _ in range(rng.randint(3, 40))) for _ in range(3)]
            parts.append((host, [top, *own, foot] if k % 5 else [f"{own[0]} {top}", own[1], foot]))
            rows.append((len(rows), f"http://h{host}/{k}", "".join(f"<div>{b}</div>" for b in parts[-1][1])))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    counts = defaultdict(set)
    for i, (host, blocks) in enumerate(parts):
        t = " ".join(blocks).split(" ")
        for k in range(len(t) - 7):
            counts[(host, tuple(t[k : k + 8]))].add(i)
    for i, (host, blocks) in enumerate(parts):
        t = " ".join(blocks).split(" ")
        gone = {j for k in range(len(t) - 7) if len(counts[(host, tuple(t[k : k + 8]))]) >= 3 for j in range(k, k + 8)}
        left, at = [], 0
        for b in blocks:
            n = len(b.split(" "))
            left.append(" ".join(x for j, x in enumerate(b.split(" "), at) if j not in gone))
            at += n
        assert got[i] == "\n\n".join(x for x in left if x)
        assert host == 2 or f"t{host}" not in got[i]  # two pages of a host keep theirs


# 3


def test_quality_learns_and_ignores_other_columns(spark, none):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, prose(40, rng) if good else " ".join([rng.choice(VOCABULARY).upper() + "!!"] * 30)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, prose(30, rng)), (5, rows[5][1])]
    labels += [(5, 1, 0), (7, None, 0), (None, 1, 0)]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held if r["doc_id"] < 400]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert by[1000]["score"] == by[1001]["score"]
    again = {r["doc_id"]: r["score"] for r in quality.classify(df.withColumn("source", F.lit("x")).coalesce(1), lab).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-3 for r in got)
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in quality.classify(df, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(none, lab).count() == 0


# 4


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), degree[i], min(least[find(i)]) if least[find(i)] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("hot, light", [(20_000, 8), (3, 8), (20_000, 0)])
def test_jaccard_is_exact(spark, docs, monkeypatch, hot, light):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "MAX_LIGHT", light)
    monkeypatch.setattr(jaccard_join, "BLOCK", 400)
    assert order(rows_of(jaccard_join.jaccard_join(docs))) == order(brute_jaccard(corpus()))


def test_jaccard_small_sets(spark, none):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 11)))) for i in range(150)]
    assert order(rows_of(jaccard_join.jaccard_join(frame(spark, rows)))) == order(brute_jaccard(rows))
    assert jaccard_join.jaccard_join(none).count() == 0


def test_jaccard_does_not_expand_a_family_in_every_list(spark, monkeypatch, tmp_path):
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(240)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 9))):
            w[rng.randrange(len(w))] = f"own{i}x{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(150, rows[3][1]), (151, " ".join(base[:200])), (152, prose(240, rng))]
    pairs, said = jaccard_join._pairs, str(tmp_path / "rows")

    def counting(x):
        run = pairs(x)

        def counted(batches):
            for b in run(batches):
                with open(said, "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b

        return counted

    monkeypatch.setattr(jaccard_join, "_pairs", counting)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3000)  # the unit is cut into blocks, too
    assert order(rows_of(jaccard_join.jaccard_join(frame(spark, rows)))) == order(brute_jaccard(rows))
    with open(said) as f:
        assert sum(int(line) for line in f) < 150 * 149 // 2 // 3  # the family's pairs, once: before, once a task


def test_jaccard_keeps_one_of_each_group(spark, docs):
    want = {c for d, _, _, c in brute_jaccard(corpus()) if d == c and d is not None}
    kept = jaccard_join.keep_first(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_components_of_chains_and_stars(spark):
    from quire.llm.common import saver

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["v"]: r["label"] for r in jaccard_join.components(spark.createDataFrame(edges, "u bigint, v bigint"), saver(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}


# 5


def brute_parse(rows):
    first = {}
    known = sorted({(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows})
    for d, t in known:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = []
    for doc, text in rows:
        d, t = -(1 << 63) if doc is None else doc, (text or "").encode()
        cover = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                cover[i : i + 50] = [True] * 50
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((doc, len(t), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("slice_, piece", [(3 << 20, 8 << 20), (2000, 8 << 20), (3 << 20, 700)])
def test_parse_is_exact(spark, docs, monkeypatch, slice_, piece):
    if (slice_, piece) != (3 << 20, 8 << 20) and not os.environ.get("QUIRE_FORKED", ""):
        # Workers import the module afresh, so other sizes are tried in this process.
        from quire.llm import words

        monkeypatch.setattr(parse_dedup, "_PIECE", piece)
        monkeypatch.setattr(words.slices, "__defaults__", (slice_,))
        rows = corpus()
        b = pa.record_batch({"text": pa.array([t or "" for _, t in rows]), "doc": pa.array([-(1 << 63) if d is None else d for d, _ in rows]), "key": pa.array(range(len(rows)))})
        hits = np.full(parse_dedup.FILTER_BITS // 8, 255, np.uint8)
        t = pa.Table.from_batches(list(parse_dedup._phrases(hits)([b]))).sort_by([("trigger", "ascending"), ("doc", "ascending")])
        spans = defaultdict(set)
        for r in parse_dedup._cover(iter(t.to_batches(max_chunksize=37))):
            for k, s, e in zip(*[c.to_pylist() for c in r.columns]):
                spans[k] |= set(range(s, e))
        assert [len(spans[i]) for i in range(len(rows))] == [w[2] for w in brute_parse(rows)]
        return
    assert order(rows_of(parse_dedup.parse_dedup(docs))) == order(brute_parse(corpus()))


def test_parse_filter_follows_the_input(spark, monkeypatch):
    monkeypatch.setattr(parse_dedup, "FILTER_BITS", 1 << 12)
    made, fill = parse_dedup._phrases, []

    def spy(hits, *rest):
        fill.append(np.unpackbits(hits).mean())
        return made(hits, *rest)

    monkeypatch.setattr(parse_dedup, "_phrases", spy)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghij ", k=2000)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:30])]
    got = {r["doc_id"]: r["n_removed"] for r in parse_dedup.parse_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 2000 * (i >= 600) for i in range(630)}
    assert 0 < fill[0] < 0.2  # a bitmap of fixed size is full, and every phrase travels


def test_parse_of_nothing(spark, none):
    assert parse_dedup.parse_dedup(none).count() == 0


# 6


def test_decontamination_is_exact(spark, docs, none):
    texts = [t for _, t in corpus()]
    items = [(1, " ".join(texts[30].split()[3:20]).upper() + "."), (2, prose(30)), (3, "one"), (4, None), (5, ""), (6, texts[0]), (6, texts[0]), (7, "words two words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def w(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    want, hit = Counter(), set()
    for i, t in set(items):
        q = w(t)
        n = min(5, len(q))
        own = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
        for d, x in set(corpus()):
            v = w(x)
            shared = len(own & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)})
            if own and shared >= -(-len(own) // 2):
                want[(d, i, len(own), shared)] += 1
                hit.add((d, x))
    got = Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["shared"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == want and want
    sketches = decontaminate.item_sketches(bench)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("_key"), decontaminate.words(F.col("text")).alias("w"))
    pairs = lambda side: decontaminate.candidates(texts, side, 10, [1, 3, 5]).count()
    every = pairs(sketches.withColumn("in_sketch", F.lit(True)))
    assert len(want) <= pairs(sketches) <= every and sketches.where("in_sketch").count() < 0.7 * sketches.count()
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r not in hit for r in corpus())
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0


def test_decontamination_hashes_only_runs_that_begin_like_an_item(spark, monkeypatch):
    items = [(1, "a b"), (2, "a b c"), (3, "c d e f g h a b c d"), (4, "x a b y z w v"), (None, "q r s"), (5, "A, b! C? d e f")]
    texts = ["", None, "a", "a b", "b a", "A-b", "c a b", "a b c", "c d e f g", "d e f g h a b c d", "x a b y", "x a b y z", "a b y z w v", "q r s", "a a b a b c d e f", "f g h a b c c d e f"]
    bench, docs = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sketches = decontaminate.item_sketches(bench)
    begin = decontaminate.starts(bench, sketches)
    w = docs.select(F.col("doc_id").alias("_key"), decontaminate.words(F.col("text")).alias("w"))
    every, found = (Counter(map(tuple, decontaminate.candidates(w, sketches, 10, [2, 3, 5], b).collect())) for b in (None, begin))
    assert found == every and len(found) > 12
    assert begin.count() <= sketches.where("in_sketch").count()
    got = [Counter(map(tuple, decontaminate.contaminated(docs, bench).collect()))]
    monkeypatch.setattr(decontaminate, "MAX_STARTS", 0)
    got.append(Counter(map(tuple, decontaminate.contaminated(docs, bench).collect())))
    assert got[0] == got[1] and {(3, 1), (6, 1), (7, 2), (9, 3), (12, 4)} <= {(r[0], r[2]) for r in got[0]}


# 7


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "é", "'s", "12", "!", "...", "\xa0", " ", "　", "“", "<|endoftext|>", "ß", "Σ", "\x1c", "\x85", "中", "👍", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None]
    for name, keeps, end in ((tokens.BYTE_BPE, True, 2), (tokens.WORD_BPE, False, 1)):
        t = Tokenizer.from_file(tokens.tokenizer_path(name))
        got = []
        for r in tokens.Encoder(tokens.tokenizer_path(name), keeps, end)(pa.array(texts)):
            got += [r.ids[a:b].tolist() for a, b in zip(r.bounds[:-1], r.bounds[1:])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


@pytest.mark.parametrize("ids", [[], [3], [7] * 5000, list(range(4097)), list(np.random.default_rng(1).integers(0, 50_257, 6000)), [int(x) for x in np.random.default_rng(2).zipf(1.3, 9000) % 50_257]])
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    blob = token_coder.encode(ids, np.array([len(ids)]), [None], 50_257)
    got, counts, docs = token_coder.decode(blob)
    assert (got == ids).all() and counts.tolist() == [len(ids)] and docs == [None]


def test_coder_finds_damage_in_its_block_only():
    ids = np.arange(9000) % 50
    whole = token_coder.encode(ids, np.array([9000]), [1], 100)
    start = 24 + int.from_bytes(whole[16:20], "little")
    for at in (start, start + 1, start + 9, 30):
        blob = bytearray(whole)
        blob[at] ^= 255
        with pytest.raises(token_coder.CorruptBlock):
            token_coder.decode(bytes(blob))
    with pytest.raises(token_coder.CorruptBlock):
        token_coder.decode(b"x" * 40)


def _peak(run):
    """MB that numpy and Python hold at most while ``run`` goes."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_workers_memory_is_bounded():
    """The memory of a Python worker follows neither the batch nor the number of short texts, and an encoder goes before other work."""
    rng = random.Random(3)
    long = pa.record_batch({"doc_id": pa.array(range(1200), pa.int64()), "text": pa.array([prose(400, rng) for _ in range(1200)])})
    short = pa.record_batch({"doc_id": pa.array(range(10_000), pa.int64()), "text": pa.array([f"w{i} of {i % 7}" for i in range(10_000)])})
    vectors = quality.WORD_INDEX
    list(quality._contexts(iter([long.slice(0, 1)])))  # what a worker keeps
    model = vectors, quality.Network(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros((quality.WIDTH, 2)), np.zeros(2), np.zeros(2), 0.0)
    score = quality._scorer(model, 1)
    assert _peak(lambda: list(quality._contexts(iter([long])))) < 45
    assert _peak(lambda: list(score(iter([long])))) < 45
    assert _peak(lambda: list(score(iter([short])))) < 45
    path = tokens.tokenizer_path(tokens.WORD_BPE)
    list(packing._cut(path, 4096)(iter([short])))
    assert tokens.encoder.cache_info().currsize
    list(quality._contexts(iter([short])))
    assert not tokens.encoder.cache_info().currsize


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    folder = f"{checkpoint_dir(spark)}/tokens-test"
    token_files.write_segments(docs, folder)
    got = sorted(rows_of(token_files.read_segments(spark, folder)), key=lambda r: r[1])
    ids = {(d, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for d, x in corpus()}
    want = Counter((d, len(i), zlib.crc32(i.tobytes())) for (d, x) in corpus() for i in [ids[(d, x)]])
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [d for d, *_ in got] == sorted([d for d, _ in corpus()], key=lambda d: (d is not None, d))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    token_files.write_segments(none, folder + "0")
    assert token_files.read_segments(spark, folder + "0").count() == 0


# 8


def brute_prints(texts):
    """Level and, per family and level, the set of terms that is hashed, for each text; by the definitions, term by term."""
    split = lambda t: {w.encode() for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))}
    hashes = {}
    for t in {x for t in texts for x in split(t)}:
        h = 0
        for k, b in enumerate(t):
            h = (h + int(words_module._TABLE[b]) * pow(words_module._BASE, k, 1 << 64)) % (1 << 64)
        hashes[t] = int(words_module.mix(np.array([h], np.uint64))[0])
    sets = [{hashes[x] for x in split(t)} for t in texts]
    cells = Counter(h % imatch.SKETCH for s in sets for h in s)
    n = len(texts)
    most, least = max(n * math.exp(-imatch.LOW_IDF), 2), max(n * math.exp(-imatch.HIGH_IDF), 2 if n > 4 else 1)
    out = []
    for s in sets:
        own = {h for h in s if least <= cells[h % imatch.SKETCH] <= most} or s
        level = max(0, int(math.floor(math.log2(max(len(own), 1) / imatch.TERMS)))) if own else 0
        lexicons = []
        for seed in imatch._SEEDS:
            mixed = {h: int(words_module.mix(np.array([h], np.uint64) ^ seed)[0]) for h in own}
            lexicons.append([frozenset(h for h, x in mixed.items() if x % (1 << (level + k)) == 0) for k in range(imatch.LEVELS)])
        out.append((level, lexicons))
    return out


def brute_likeness(one, other):
    used = same = 0
    for a, b in zip(one[1], other[1]):
        for i, x in enumerate(a):
            j = one[0] + i - other[0]
            if 0 <= j < imatch.LEVELS and (x or b[j]):
                used += 1
                same += x == b[j]
    none = not any(x for f in one[1] + other[1] for x in f)
    return 1.0 if none else same / max(used, 1)


def test_imatch_is_what_its_definition_says():
    rng = random.Random(12)
    texts = [prose(rng.randint(0, 120), rng) for _ in range(30)]
    texts += [texts[0], texts[1] + " extra", "", "", prose(900, rng), " ".join(texts[2].split()[:30] + texts[3].split()[:30])]
    sketch = np.zeros(imatch.SKETCH, np.uint32)
    for w in words_module.words(pa.array(texts), breaks=words_module.TERM_BREAKS):
        np.add.at(sketch, (words_module.terms(w)[0] & np.uint64(imatch.SKETCH - 1)).astype(np.int64), np.uint32(1))
    got, want = imatch.fingerprints(pa.array(texts), imatch.band(sketch, len(texts))), brute_prints(texts)
    assert got[0].tolist() == [w[0] for w in want]
    for i, (_, lexicons) in enumerate(want):
        assert [[bool(h) for h in f] for f in got[1][i]] == [[bool(x) for x in f] for f in lexicons]
    # Equal sets, and only they, have equal hashes.
    for f in range(imatch.FAMILIES):
        seen = {}
        for i, (_, lexicons) in enumerate(want):
            for k, x in enumerate(lexicons[f]):
                if x:
                    assert seen.setdefault(x, got[1][i, f, k]) == got[1][i, f, k]
        assert len(set(seen.values())) == len(seen)
    for i in range(len(texts)):
        j = (i * 7 + 1) % len(texts)
        at = lambda k: (got[0][[k]], got[1][[k]])
        assert imatch.likeness(at(i), at(j))[0] == pytest.approx(brute_likeness(want[i], want[j]))
    mean = np.mean([len(x) for _, lexicons in want[:30] for f in lexicons for x in f[:1] if x])
    assert mean > imatch.TERMS  # whole subsets of the band, not single terms


def test_imatch(spark, docs, none):
    got = imatch.fingerprint_table(docs).collect()
    rows = corpus()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    known = sorted((d, t or "") for d, t in rows if d is not None)
    texts = dict(known)
    single = [d for d, n in Counter(d for d, _ in known).items() if n == 1]
    for (d, t), (e, u) in zip(known, known[1:]):
        if d in single and e in single:
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            r = by[d][0]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] == by[e][0]["fingerprint"]) == (r["near_next"] == 1)
    prints = defaultdict(set)
    for r in got:
        if r["doc_id"] in texts:
            prints[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r["n_chars"] > 150]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long])
    one = imatch.fingerprint_table(frame(spark, [(4, "ab c")])).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"], r["edited_sha256"]) for r in one] == [(4, 4, 1.0, hashlib.sha256(b"abab").hexdigest())]
    assert imatch.fingerprint_table(none).count() == 0


# 9


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(tokens.WORD_BPE))
    got = packing.pack(docs).collect()
    pieces = Counter()
    for d, x in corpus():
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            pieces[(d, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack(none).count() == 0


def test_grouping_genetic_algorithm():
    rng = random.Random(4)
    lengths = [rng.choice((rng.randint(1, 200), rng.randint(1000, 3000))) for _ in range(300)]
    bins = packing.evolve(lengths, 4096, 1)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 4096) + 1
    again = packing.mutate(bins, lengths, 4096, rng)
    assert sorted(i for b in again for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 4096 for b in again)
    child = packing.crossover(bins, packing.best_fit(list(range(300)), lengths, 4096), lengths, 4096)
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 4096 for b in child)


def test_elites_migrate_as_lengths(spark):
    rng = random.Random(6)
    lengths = [rng.randint(1, 4000) for _ in range(200)]
    elite = packing.evolve(lengths, 4096, 1)
    shuffled = lengths[:150] + [rng.randint(1, 4000) for _ in range(50)]
    bins = packing.immigrant([[lengths[i] for i in b] for b in elite], shuffled, 4096)
    assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(shuffled[i] for i in b) <= 4096 for b in bins)
    have = Counter(tuple(sorted(shuffled[i] for i in b)) for b in bins)
    came = [tuple(sorted(lengths[i] for i in b)) for b in elite if max(b) < 150 and len(b) > 1]
    assert sum(p in have for p in came) >= 0.8 * len(came) > 0  # an elite bin whose lengths are there arrives whole
    # Three islands: all pieces once, gapless, within the capacity, ids above 2**53 and nulls intact.
    big = (1 << 60) + 1
    frame_ = spark.createDataFrame([(None if i % 50 == 0 else big + i, prose(rng.randint(1, 60), rng)) for i in range(120)], "doc_id bigint, text string")
    old = packing.ISLAND
    packing.ISLAND = 50
    try:
        got = packing.pack(frame_, capacity=256).collect()
    finally:
        packing.ISLAND = old
    assert {r["doc_id"] for r in got} == {None, *(big + i for i in range(120) if i % 50)}
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in held.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 256
    assert len(held) <= -(-sum(r["length"] for r in got) // 256) * 1.03 + 1


# 10


def test_line_dedup(spark, docs, none):
    rows = corpus()
    key = lambda r: ((r[0] is not None, r[0] or 0), r[1] or "")
    first, want = {}, Counter()
    split = lambda t: (t or "").split("\n")
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect())
    for d, t in sorted(set(rows), key=key):
        ls = split(t)
        for i in range(len(ls) - 2):
            first.setdefault(tuple(ls[i : i + 3]), (d, t, i))
    for d, t in rows:
        ls = split(t)
        gone = {j for i in range(len(ls) - 2) if first[tuple(ls[i : i + 3])] != (d, t, i) for j in range(i, i + 3)}
        want[(d, "\n".join(x for i, x in enumerate(ls) if i not in gone) if gone else t, len(ls), len(gone))] += 1
    assert got == want and any(k[3] for k in want)
    assert line_dedup.line_dedup(none).count() == 0
    assert line_dedup.line_dedup(docs).columns[:2] == ["doc_id", "source"]


# Clashing names


def test_any_column_name_passes_through(spark):
    names = ["doc_id", "text", "_key", "_row", "_covered", "_score", "score", "_m", "_p", "n_lines", "n_removed", "n_values", "n_card", "a.b", "first", "key", "cid"]
    rows = [(i, t, *[k * 10 + i for k in range(len(names) - 2)]) for i, t in enumerate(["a\nb\nc\nd " + "word " * 30, "a\nb\nc\ne mail x@y.example", "other words here", None])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'bigint'}" for n in names))
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, "other words here")], "item_id bigint, text string")
    others = [n for n in names if n != "text"]
    want = {r[0]: tuple(x for n, x in zip(names, r) if n != "text") for r in rows}

    def same(result):
        got = result.select(*[F.col(f"`{n}`") for n in others]).collect()
        return all(tuple(r) == want[r[0]] for r in got) and {r[0] for r in got}

    assert same(line_dedup.line_dedup(df)) == {0, 1, 2, 3} and {"n_lines_", "n_removed_"} <= set(line_dedup.line_dedup(df).columns)
    assert same(pii.pseudonymise(df, "k")) == {0, 1, 2, 3} and {"n_values_", "n_card_", "n_email"} <= set(pii.pseudonymise(df, "k").columns)
    assert same(decontaminate.decontaminate(df, items)) == {0, 1, 3} and decontaminate.decontaminate(df, items).columns == names
    assert same(quality.keep_good(df, labels)) and quality.keep_good(df, labels).columns == names
    assert same(jaccard_join.keep_first(df)) == {0, 1, 2, 3} and jaccard_join.keep_first(df).columns == names
    for made in (jaccard_join.jaccard_join, parse_dedup.parse_dedup, imatch.fingerprint_table):
        assert made(df).count() == 4
    assert packing.pack(df).count() == 4
