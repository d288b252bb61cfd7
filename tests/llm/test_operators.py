"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sluicegate.llm import decontaminate, jaccard_join, kn_lm, language_id, line_dedup, quality_rules, toxicity, viterbi_pieces, warc_index

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(300)]
SPACE = r"[^\x20\x09-\x0D]+"


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = [sentence(40) for _ in range(12)]
COMMON = "This line is in many documents."
TEXTS = [None, "", " \n\t", "one", "one two three", *BASE, *[b + " " + sentence(3) for b in BASE[:6]], BASE[0], BASE[0], *[f"{sentence(30)}\n {COMMON.upper()} \n{COMMON}" for _ in range(12)], "x " * 30000, "A" * 20000, "same same same same same same same same same same same same"]
DOCS = [(i, t, "en" if i % 2 else None, "h", "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "one", None, "h", "clash", 1)]
COLUMNS = "doc_id long, text string, lang string, source string, n_lines string, words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def duck(sql, rows=DOCS):
    con = duckdb.connect()
    unique = {r[0]: r for r in rows}.values()
    con.register("documents", pa.table({"doc_id": [r[0] for r in unique], "text": pa.array([r[1] for r in unique], pa.string()), "source": [r[3] for r in unique]}))
    return con.sql(sql).df()


def as_set(df, columns):
    return {tuple(r[c] for c in columns) for r in df}


def test_warc(spark):
    big = "<p>é</p>" * 300
    pages = spark.createDataFrame([(1, "http://User@WWW.Example.com:80/a?b#c", big, 0), (5, "https://example.com/a", big, 0), (3, None, big, 0), (3, None, big, 0), (7, "not a url", "small", 0), (8, "http://x.org", "small", 0), (9, "http://x.org", None, 0), (None, "http://n.org", big, 0)], "page_id long, url string, html string, payload int")
    folder = warc_index.archive(spark, pages)
    keyed = pages.select(warc_index.url_key(pages.url).alias("urlkey"), "page_id")
    assert "com,example,www)/a?b" in {r[0] for r in keyed.collect()}
    got = warc_index.read_records(warc_index.lookup(keyed, f"{folder}/index"), f"{folder}/archive").collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == sorted([(1, "revisit", 5, 2700), (5, "response", 0, 2700), (3, "revisit", 5, 2700), (3, "revisit", 5, 2700), (7, "response", 0, 5), (8, "response", 0, 5), (9, "response", 0, 0), (0, "revisit", 5, 2700)])
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 2700} == {digest}
    reader = warc_index.IndexReader(f"{folder}/index")
    assert len(reader.find(")not a url".replace(" ", ""), 7)) + len(reader.find(")notaurl", 7)) >= 1 and reader.find("zzz", 1) == []
    empty = warc_index.archive(spark, pages.where("false"))
    assert warc_index.lookup(keyed, f"{empty}/index").collect() == []


def test_quality(docs, none):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "kept"]
    got = as_set(quality_rules.quality(docs).collect(), names)
    want = {tuple(r) for r in duck(quality_rules.OP2_SQL)[names].astype(object).values.tolist()}
    assert got == want and any(r[7] > 0 for r in got)
    assert quality_rules.quality(none).collect() == []


def test_quality_removes_common_lines(docs):
    got = quality_rules.cleaned(docs).collect()
    text = dict(DOC[:2] for DOC in DOCS)
    gone = lambda t: "\n".join(x for x in t.split("\n") if x.strip().lower() != COMMON.lower())
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((d[0], gone(d[1] or "")) for d in DOCS)
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None] and sum(r["text"] != text[r["doc_id"]] for r in got) == 12
    size = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t or ""))
    assert all(r["removed_chars"] == r["word_chars"] - size(r["text"]) for r in got)


def test_line_dedup(docs, none):
    from pyspark.sql import functions as F

    kept = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, 10)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert as_set(kept.collect(), names) == {tuple(r) for r in duck(line_dedup.OP3_SQL)[names].astype(object).values.tolist()}
    first = line_dedup.line_bitmaps(docs, 10, keep_first=True).where("n_dropped > 0").collect()
    assert len(first) == 12 and sorted(r["n_dropped"] for r in first) == [1] + [2] * 11
    for r in first:
        assert line_dedup.decode_bitmap(r["keep_bitmap"], r["n_lines"]).sum() == r["n_lines"] - r["n_dropped"]
    assert line_dedup.line_bitmaps(none).collect() == []


def test_runs_that_cross_partitions(spark):
    lines = spark.createDataFrame([(i, "hot\n" + ("cold" if i < 5 else f"own {i}")) for i in range(400)], "doc_id long, text string")
    for n in ("2", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {r["n_dropped"]: r["count"] for r in line_dedup.line_bitmaps(lines, 10).groupBy("n_dropped").count().collect()} == {1: 400}
        first = line_dedup.line_bitmaps(lines, 10, keep_first=True).where("n_dropped = 0").collect()
        assert [r["doc_id"] for r in first] == [0]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def jaccard(rows):
    """(doc_id, size, smallest doc_id that is reached) of each row by comparing all sets."""
    words = [re.findall(SPACE, re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)].append(i)
    return Counter((i, len(s), min(groups[find(k)], default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def components_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(df).collect())


def test_jaccard(spark, docs, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(docs).collect())
    assert got == jaccard([d[:2] for d in DOCS]) and len({c for *_, c in got}) < len(DOCS) - 6
    assert jaccard_join.similarity_components(none).collect() == []


def test_jaccard_of_nameless_and_repeated_rows(spark):
    a, b, c = BASE[0], BASE[0] + " " + sentence(3), BASE[1]
    rows = [(None, a), (1, b), (7, c), (7, sentence(40)), (4, c + " end"), (None, sentence(30)), (None, sentence(30) + " x"), (9, a), (9, a), (None, None), (3, "É é é é é"), (2, "é é é é é")]
    got = components_of(spark, rows)
    assert got == jaccard(rows) and got[None, 36, 1] == 1 and got[7, 36, 4] == 1


def test_jaccard_of_a_group_in_which_many_are_not_linked(spark, monkeypatch):
    base = sentence(90).split()

    def edited(n):
        w = list(base)
        for k in RNG.sample(range(90), n):
            w[k] = RNG.choice(WORDS)
        return " ".join(w)

    rows = [(k, edited(RNG.choice([0, 1, 1, 2, 2, 3, 4, 9]))) for k in range(150)] + [(200 + k, sentence(60)) for k in range(30)]
    for k, size in enumerate((130, 200, 260, 300, 700, 1300)):  # sets of all sizes, with a copy that shares just enough or too little
        text = sentence(size)
        rows += [(300 + 10 * k + j, text + " " + sentence(int(size * share))) for j, share in enumerate((0, 0.2, 0.32, 0.35))]
    want = jaccard(rows)
    assert 3 < len({c for *_, c in want if c < 200}) < 150
    assert components_of(spark, rows) == want
    for name, value in (("RUN_ROWS", 16), ("BLOCK_SIZE", 500), ("QUERIES", 3), ("HELD_PAIRS", 40), ("FANOUT", 4), ("CROWD", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert components_of(spark, rows) == want  # in many blocks
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "REPEATS", 0)
    assert components_of(spark, rows) == want


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for b in base for k in (0, 5, 20, 60)]
    vec, n = np.stack([jaccard_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree, found = jaccard_join.RTree(vec, n, np.arange(len(sets))), 0
    assert len(tree.levels) > 1
    near = set(zip(*(x.tolist() for x in tree.search(vec, n, np.arange(len(sets)))[:2])))
    for i, s in enumerate(sets):
        for j, o in enumerate(sets):
            same = len(np.intersect1d(s, o))
            if i != j and 100 * same >= 75 * (len(s) + len(o) - same):
                assert (i, j) in near
                found += 1
    assert 100 < found <= len(near) < len(sets) ** 2 / 4


def test_bounds_of_very_large_sets():
    big = jaccard_join.count_vector(np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
    small = jaccard_join.count_vector(np.arange(64, dtype=np.uint64) << np.uint64(58))
    assert jaccard_join.bounds(big, big) > 1 << 20 and jaccard_join.bounds(big, small) == 64


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, BASE[3]), (2, "What is it? " + sentence(12)), (3, None), (4, ""), (5, sentence(20)), (6, BASE[3])], "item_id long, text string")
    got = as_set(decontaminate.leaks(docs, items).collect(), ["doc_id", "item_id"])
    plain = lambda t: " ".join(decontaminate.plain_words(t))
    want = {(i, k) for i, t, *_ in DOCS for k, x in ((1, BASE[3]), (6, BASE[3])) if plain(x) in plain(t)}
    assert want and got == want
    assert decontaminate.leaks(none, items).collect() == [] and decontaminate.leaks(docs, items.where("false")).collect() == []


def bm25(items, passage):
    """Share of each item's own BM25 score that the passage's distinct words hold, by the formula."""
    plain = {i: decontaminate.plain_words(t) for i, t in items}
    n, mean = len(plain), sum(map(len, plain.values())) / len(plain)
    df, held, out = Counter(w for own in plain.values() for w in set(own)), set(decontaminate.plain_words(passage)), {}
    for i, own in plain.items():
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, f in Counter(own).items()}
        out[i] = sum(x for w, x in weight.items() if w in held) / sum(weight.values())
    return out


def test_wand_retrieves_what_scoring_all_items_does():
    items = [(k, " ".join(RNG.sample(WORDS[: 60 + k], RNG.randint(6, 40)))) for k in range(150)]
    index = decontaminate.ItemIndex(items, decontaminate.item_figures([items]))
    read = total = found = 0
    for _ in range(150):
        i, passage = RNG.randrange(150), RNG.sample(WORDS, 30)
        passage += items[i][1].split()[: RNG.randint(0, 30)]
        terms = np.unique([index.terms[w] for w in passage if w in index.terms])
        for threshold in (0.3, 0.5, 0.8):
            got, postings = index.wand(terms, threshold)
            want = {k: x for k, x in bm25(items, " ".join(passage)).items() if x >= threshold}
            assert {index.ids[k]: x for k, x in got} == pytest.approx(want)
            read, total, found = read + postings, total + sum(len(index.postings[t][0]) for t in terms), found + len(want)
    assert found > 100 and read < total / 3


def test_decontamination_equals_scoring_all_passages(spark, docs, monkeypatch):
    items = [(k, f"{sentence(10)}? {sentence(5)}") for k in range(30)] + [(k, sentence(RNG.randint(8, 60))) for k in range(30, 50)]
    texts = []
    for k in range(200):  # copies in part, with other words between
        own = items[k % 50][1].split()
        cut = RNG.randint(len(own) // 3, len(own))
        texts.append((k, f"{sentence(RNG.randint(0, 150))} {' '.join(own[:cut])} {sentence(RNG.randint(0, 9))} {' '.join(own[cut:])} {sentence(RNG.randint(0, 150))}"))
    figures, want = decontaminate.item_figures([items]), {}
    size = max(64, figures[2])
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for d, text in texts:
        own = decontaminate.plain_words(text)
        for s in range(0, max(len(own), 1), size):
            passage = own[s : s + 2 * size]
            for i, score in bm25(items, " ".join(passage)).items():
                parts = decontaminate.split_item(dict(items)[i])
                over = [len(grams(p, min(3, len(p))) & grams(passage, min(3, len(p)))) / len(grams(p, min(3, len(p)))) for p in parts]
                if score >= 0.5 and over[0] >= 0.6 and over[1] >= 0.5:
                    want[d, i] = [max(a, b) for a, b in zip(want.get((d, i), [0, 0, 0]), [score, *over])]
    for name, value in (("HELD_BOUNDS", 4_000_000), ("HELD_BOUNDS", 300), ("PASS_ITEMS", 7)):
        monkeypatch.setattr(decontaminate, name, value)
        got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r["doc_id"], r["item_id"]): list(r[2:]) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    assert 50 < len(want) < 200


def test_all_contained_items_are_found(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    squeezed = lambda t: " " + " ".join(decontaminate.plain_words(t)) + " "
    items = {r["item_id"]: squeezed(r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()}
    rare = {i: max(t.split(), key=len) for i, t in items.items()}
    want = set()
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        low = (r["text"] or "").lower()
        near = [i for i in items if rare[i] in low]
        own = squeezed(r["text"]) if near else ""
        want |= {(r["doc_id"], i) for i in near if items[i] in own}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontamination(spark, sf).collect()}
    assert len(want) > 200 and want <= got


def test_decontamination_in_parts_equals_one_pass(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, sentence(5 * (k % 4)) + " " + b) for k, b in enumerate(BASE)], "item_id long, text string")
    found = lambda: {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontaminate.leaks(docs, items).collect()}
    whole = found()
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 4)
    assert whole and found() == whole


def test_decontamination_of_short_parts(spark):
    items = [(1, "Which city lies on the river Seine and is a capital? Paris"), (2, "Who wrote the long poem about a sailor and a bird? Samuel Coleridge"), (3, "seven plain words without any question mark"), (4, "Really? Yes"), (5, "lonely"), (6, "ten plain words with no mark at their very end")]
    docs = [(k, f"{sentence(70)} {t}. {sentence(70)}") for k, t in items] + [(11, items[0][1]), (12, items[0][1].replace("Paris", "Rome")), (13, sentence(90))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k, _ in items} | {(11, 1)}


def test_decontamination_beyond_ascii(spark):
    items = [(1, "École Été Ñandú Übung Élan " * 4), (2, "ПРИВЕТ МИР Это Большой Город На Реке И Он Стоит Там Давно"), (3, "ΑΘΗΝΑ Είναι Η Πόλη Που Όλοι Θέλουν Να Δουν Κάθε Χρόνο Ξανά"), (4, "one\u00a0two three\u2003four five\u00a0six seven eight\u00a0nine ten eleven twelve"), (5, "Straße İstanbul ΟΔΟΣ Ǆ Ẁ Ỳ Ω K Å Ⅷ Ⓐ Ａ Ω É")]
    docs = [(k, f"{sentence(30)} {t} {sentence(30)}") for k, t in items] + [(9, sentence(80))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in got} == {(k, k, 1.0, 1.0) for k, _ in items}


def test_language(spark, docs, none):
    rows = [(i, " ".join(RNG.choice(v) for _ in range(30)), k, "s", "", 0) for i in range(120) for k, v in (("xa", ["alba", "lana", "nala"]), ("yo", ["ytro", "roty", "tyro"]))]
    model = language_id.fit(spark.createDataFrame(rows, COLUMNS))
    tests = spark.createDataFrame([(1, "alba nala lana", None, "", "", 0), (2, "roty tyro", None, "", "", 0), (3, None, None, "", "", 0), (4, "12 !?", None, "", "", 0), (5, "", None, "", "", 0)], COLUMNS)
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.predict(tests, model, reject=False).collect()}
    assert got == {1: ("xa", True), 2: ("yo", True), 3: ("und", True), 4: ("und", True), 5: ("und", True)}
    far = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(6, "qqq zzz kkk www", None, "", "", 0)], COLUMNS), model).collect()}
    assert far == {6: "und"}
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(none)).collect()} == {"und"}


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = language_id.op7_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", "lang_pred", "rejected", "text").collect()
    assert len(got) > 2000 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.995 * len(got)
    assert sum(r["rejected"] for r in got) < 0.02 * len(got)


def test_language_of_odd_texts(spark):
    rows = [(i, " ".join(RNG.choice(v) for _ in range(30)), k, "s", "", 0) for i in range(120) for k, v in (("xa", ["alba", "lana", "nala"]), ("yo", ["ytro", "roty", "tyro"]))]
    model = language_id.fit(spark.createDataFrame(rows, COLUMNS))
    odd = ["alba lana nala " * 20000, "a", "ALBA Nala", "alba nala", "alba nala", "漢字 だけ", "alba roty"]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame([(k, t, None, "", "", 0) for k, t in enumerate(odd)], COLUMNS), model).collect()}
    assert got[0]["lang_pred"] == "xa" and got[2][1:] == got[3][1:] == got[4][1:] and got[5]["lang_pred"] == "und" and got[5]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    same = {"langs": ["b", "c"], "idf": model["idf"], "centroids": np.repeat(model["centroids"][:1], 2, 0), "of": np.array([0, 1]), "least": np.zeros(2)}
    assert {r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, "alba", None, "", "", 0)], COLUMNS), same).collect()} == {"b"}


def word_ratios(rows, asked):
    """Log-likelihood ratios of words by plain counting of their beginnings in the words of each text."""
    count = [defaultdict(Counter), defaultdict(Counter)]
    for text, toxic in rows:
        for w in {x.strip(toxicity.STRIP) for x in text.lower().split()} - {""}:
            for k, c in enumerate(w + "$"):
                count[toxic][w[:k]][c] += 1
    both = defaultdict(Counter)
    for c in count:
        for h, n in c.items():
            both[h].update(n)

    def parts(c):
        cc = Counter(n for after in c.values() for n in after.values())
        d = kn_lm.discounts({f"n{k}": cc[k] for k in (1, 2, 3, 4)})
        cut = lambda n: 0 if not n else d[min(n, 3) - 1]
        return lambda h, x: c[h][x] - cut(c[h][x]), lambda h: sum(map(cut, c[h].values()))

    net, freed = parts(both)
    left = lambda h: freed(h) / both[h].total()
    shared = lambda h, x: net(h, x) / both[h].total() + left(h) / 64

    def model(c):
        own, lost = parts(c)

        def p(h, x):
            rest = c[h].total() - lost(h)
            return own(h, x) / rest * (1 - left(h)) + left(h) * shared(h, x) if rest > 0 else shared(h, x)

        return p

    o, t = map(model, count)
    return [sum(math.log(t(w[:k], x) / o(w[:k], x)) for k, x in enumerate(w + "$") if both[w[:k]][x]) for w in asked]


def test_toxicity_ratios_equal_plain_counting(spark):
    rows = [(k, sentence(25) + (" vile, rotten" if k % 5 == 0 else " fine") + (" " + sentence(5).upper()), int(k % 5 == 0)) for k in range(60)]
    used = spark.createDataFrame([(t, x, k % 3) for k, t, x in rows], "text string, toxic int, fold int")
    counts = used.mapInArrow(toxicity._counts, f"v long, w long, {', '.join(f'{c} long' for c in toxicity.CELLS)}").groupBy("v", "w").sum(*toxicity.CELLS).toDF("v", "w", *toxicity.CELLS)
    asked = ["vile", "VILE!", "vilest", "rot", "fine", "zebra", *WORDS[:20]]
    plain = [w.strip("!").lower() for w in asked]
    folder = kn_lm.shared_dir(spark, "toxic-test")
    toxicity._save(folder, {"known": toxicity.ratios(counts, [[0, 2], [0, 1, 2]], folder)})
    for model, folds in enumerate(([0, 2], [0, 1, 2])):
        x = toxicity.features(folder, model)(pa.array([*asked, None, " ".join(asked)]))
        want = word_ratios([(t, y) for k, t, y in rows if k % 3 in folds], plain)
        assert x[: len(asked), 0].tolist() == pytest.approx(want, abs=1e-9) and want[0] > 1 and want[5] == 0
        assert x[len(asked)].tolist() == [0] * 5
        own = sorted(set(zip(plain, want)), key=lambda r: -r[1])
        assert x[-1].tolist() == pytest.approx([*(sum(r for _, r in own[:k]) for k in (2, 4, 8)), sum(r for _, r in own) / len(own), math.log(len(own))])


def test_toxicity(spark, none):
    rows = [(i, sentence(40) + (" vile!" if i % 7 == 0 else "") + " " + sentence(10)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(600)] + [(None, 1), (5, None), (3, 0), (601, 0), (601, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 7 == 0) for i in range(600, 900))
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 20000), (4, "12 .. !"), (5, "v" * 30000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r["toxic_score"] <= 1 for r in odd) and odd[0]["toxic_score"] == odd[1]["toxic_score"] == odd[3]["toxic_score"] < 0.7
    assert {r["toxic_score"] for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(none, model).collect() == []


def test_toxicity_of_held_out_rows(spark):
    """About 40 of the 449 toxic rows hold no word that only toxic rows hold."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").select("toxic", "predicted").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in got)
    assert hits >= 0.85 * sum(r["toxic"] for r in got) and hits >= 0.9 * sum(r["predicted"] for r in got)


def test_best_cut():
    y = np.array([1, 1, 0, 1, 0, 0.0])
    assert toxicity.best_cut(np.array([9, 8, 7, 6, 2, 1.0]), y) == 4 and toxicity.best_cut(np.array([1, 1, 1, 1, 1, 1.0]), y) == 1


def test_language_model(docs, none, monkeypatch):
    train = [r for r in DOCS if r[0] % 3]
    texts, tokens = [r[1] for r in DOCS], lambda t: [*re.findall(SPACE, (t or "").lower()), "</s>"]
    words = Counter(w for r in train for w in tokens(r[1]))
    base = [sum(math.log10((words[w] + 1) / (words.total() + len(words) + 1)) for w in tokens(t)) for t in texts]
    want = every_word([r[1] for r in train], texts)[1]
    for name, value in (("HELD", 1_000_000), ("HELD", 100), ("BUCKET", 3000)):  # counted at once, in many runs, in many buckets
        monkeypatch.setattr(kn_lm, name, value)
        got = sorted(kn_lm.score_documents(docs, kn_lm.train(docs.where("doc_id % 3 <> 0"))).collect(), key=lambda r: (r["doc_id"], r["score"]))
        order = sorted(range(len(DOCS)), key=lambda k: (DOCS[k][0], want[k]))
        assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(DOCS[k][0], len(tokens(texts[k])), sum(words[w] > 0 for w in tokens(texts[k])), words.total()) for k in order]
        assert [r["base_score"] for r in got] == pytest.approx([base[k] for k in order], rel=1e-9)
        assert [r["score"] for r in got] == pytest.approx([want[k] for k in order], rel=1e-6)
        assert [r["perplexity"] for r in got] == pytest.approx([10 ** (-want[k] / len(tokens(texts[k]))) for k in order], rel=1e-5)
    empty = kn_lm.train(none)
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in kn_lm.score_documents(docs, empty).collect())


def test_language_model_where_files_cannot_be_mapped(spark, docs, monkeypatch):
    folder = kn_lm.train(docs)
    texts = pa.array([t for _, t, *_ in DOCS], pa.string())
    mapped = kn_lm.scorer(folder)(texts)["score"]
    start = kn_lm.Files.__init__

    def unmapped(self, folder):
        start(self, folder)
        self.mapped = False

    monkeypatch.setattr(kn_lm.Files, "__init__", unmapped)
    monkeypatch.setattr(kn_lm, "CACHE", 2000)
    assert kn_lm.scorer(folder)(texts)["score"].tolist() == mapped.tolist()


def every_word(train, test):
    """Log10 scores by plain counting, each word of the training texts for itself."""
    tokens = lambda t: ["<s>", *re.findall(SPACE, (t or "").lower()), "</s>"]
    pairs = Counter(p for t in train for p in zip(tokens(t), tokens(t)[1:]))
    cc, after, before = Counter(pairs.values()), defaultdict(Counter), Counter(b for _, b in pairs)
    for (a, b), n in pairs.items():
        after[a][b] = n
    bc = Counter(before.values())
    d, e = (kn_lm.discounts({f"n{k}": c[k] for k in (1, 2, 3, 4)}) for c in (cc, bc))
    cut = lambda n, d: 0 if not n else d[min(n, 3) - 1]
    types, rest = len(pairs), sum(cut(n, e) for n in before.values()) / len(pairs) / (len(before) + 1)

    def p(a, w):
        low, c = max(before[w] - cut(before[w], e), 0) / types + rest, sum(after[a].values())
        return (max(after[a][w] - cut(after[a][w], d), 0) + sum(cut(n, d) for n in after[a].values()) * low) / c if c else low

    return p, [sum(math.log10(p(a, w)) for a, w in zip(tokens(t), tokens(t)[1:])) for t in test]


def test_language_model_counts_words_found_once(spark):
    train = [*BASE, "alone beside " + BASE[0], "gamma delta", "the the the a b"]
    test = [None, "", "alone beside", "alone unheard", "unheard beside", "unheard unread", "gamma delta", "delta gamma", *BASE[:3]]
    folder = kn_lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in kn_lm.score_documents(spark.createDataFrame([(i, t) for i, t in enumerate(test)], "doc_id long, text string"), folder).collect()}
    p, want = every_word(train, test)
    assert [got[i] for i in range(len(test))] == pytest.approx(want, abs=1e-3)
    assert got[2] > got[3] > got[5] and got[6] > got[7]
    words = {w for t in train for w in re.findall(SPACE, t.lower())} | {"</s>", "unheard"}
    assert all(sum(p(a, w) for w in words) == pytest.approx(1) for a in ("<s>", "gamma", "unheard"))


def viterbi(pieces, text):
    """Ids of normalised text by the best of all segmentations, whole text at once; of equal ones, that with the longer piece."""
    score = {i: s for i, s in pieces.table.values() if i >= 0}
    named = {p: i for p, (i, _) in pieces.table.items() if i >= 0}
    best = [(0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for size in range(min(16, end), 0, -1):  # a longer piece goes before a shorter one of the same score
            i = named.get(text[end - size : end])
            if i is not None:
                options.append((best[end - size][0] + score[i], (end - size, [i])))
        if text[end - 1] not in named:
            raw = text[end - 1].encode()
            options.append((best[end - 1][0] + pieces.byte_score * len(raw), (end - 1, [pieces.byte_id[b] for b in raw])))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    out, at = [], len(text)
    while at:
        at, ids = best[at][1]
        out = ids + out
    return out


@pytest.fixture(scope="module")
def pieces():
    with open(viterbi_pieces.MODEL, "rb") as f:
        return viterbi_pieces.Pieces(f.read())


def test_piece_scores_follow_the_ranks(pieces):
    normal = sorted((i, s) for i, s in pieces.table.values() if i >= 0)
    total = sum(1 / (k + 2.7) for k in range(1, len(normal) + 1))
    assert pieces.longest == 16 and all(s == round(-(1 << 20) * math.log((k + 2.7) * total)) for k, (_, s) in enumerate(normal, 1))
    assert pieces.byte_score == round((1 << 20) * (-math.log((len(normal) + 2.7) * total) - 10))


def test_pieces(docs, none):
    got = viterbi_pieces.encode_documents(docs).collect()
    assert len(got) == len(DOCS) and all(r["round_trip"] for r in got)
    assert {r["n_ids"] for r in got if r["doc_id"] == 1} == {0} and [r["ids"] for r in got if r["doc_id"] == 0] == [None]
    assert all(r["n_ids"] == len(r["ids"]) for r in got if r["ids"] is not None)
    assert viterbi_pieces.encode_documents(none).collect() == []


def test_pieces_of_a_stream_equal_those_of_the_whole_text(pieces):
    meta = viterbi_pieces.META
    for _ in range(300):
        t = "".join(RNG.choice("abcdetion  é漢😀\n.,the") for _ in range(RNG.choice([3, 20, 300])))
        normal = meta + t.replace(" ", meta)
        want = viterbi(pieces, normal)
        assert pieces.encode(t) == want == streamed(pieces, [normal[:7], normal[7:]])[1]
        assert pieces.decode(want) == t
    for t in ("a▁b ▁", "▁", "▁▁x", " ", "  two  spaces  "):
        assert pieces.decode(pieces.encode(t)) == t


def streamed(pieces, chunks):
    """Commits, ids and characters of a stream."""
    parts = list(pieces.commits(chunks))
    return sum(n for n, _, _ in parts), [int(i) for _, ids, _ in parts for i in ids], sum(int(x.sum()) for _, _, x in parts)


def test_streams_of_real_texts_commit_again_and_again(pieces, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t for t in texts if t][:60]
    for patience in (1 << 12, 64):
        monkeypatch.setattr(viterbi_pieces, "PATIENCE", patience)
        for t in texts:
            normal = viterbi_pieces.META + t.replace(" ", viterbi_pieces.META)
            commits, ids, characters = streamed(pieces, (normal[k : k + 50] for k in range(0, len(normal), 50)))
            assert ids == pieces.encode(t) == viterbi(pieces, normal) and characters == len(normal)
            assert commits >= normal.count(viterbi_pieces.META) - normal.count(viterbi_pieces.META * 2)
            held, whole = 0, 0  # a window isn't kept beyond what no boundary cuts
            for _, _, x in pieces.commits([normal[k : k + 50] for k in range(0, len(normal), 50)]):
                whole += int(x.sum())
                held = max(held, int(x.sum()))
            assert whole == len(normal) and held <= 50 + max(map(len, normal.split(viterbi_pieces.META))) + 2 * pieces.longest


def test_streams_without_a_boundary(pieces, monkeypatch):
    """Long texts in which pieces always reach across: their paths are walked back, or kept if they never meet."""
    for patience in (1 << 12, 40):
        monkeypatch.setattr(viterbi_pieces, "PATIENCE", patience)
        for t in ("A" * 3000, "ab" * 1500, "-=" * 700 + "é" * 50, "".join(RNG.choice("inter") for _ in range(2500)), "______" * 200 + "x"):
            commits, ids, characters = streamed(pieces, (t[k : k + 33] for k in range(0, len(t), 33)))
            assert ids == viterbi(pieces, t) and characters == len(t) and commits >= 1
            assert pieces.decode(pieces.encode(t)) == t


def test_slices_of_many_texts(pieces):
    texts = [None, "", "a", " ", "▁", "▁ a", "b ▁", "a  b", *BASE, "x " * 100, "漢字 と かな", "\n\n", None]
    ids, at = pieces.encode_all(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (pieces.encode(t) if t else [])
    assert pieces.decode_all(ids, at).to_pylist() == [(t or "").encode() for t in texts]
