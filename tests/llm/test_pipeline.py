"""Each stage of the pipeline and all of them together against plain Python, with odd ids, columns and tables."""

import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from sluicegate.llm import decontaminate
from tests.llm.test_operators import jaccard

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("klmnoprstuaei") for _ in range(RNG.randint(3, 8))) for _ in range(900)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _none string, _rest int, n_lines string, _own int, toxic_score string, `a.b` int"


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ITEMS = [(k, f"{sentence(14)}? {sentence(6)}") for k in range(8)]
COMMON = ["Footer that all have", "  FOOTER that all have ", "another common line here"]


def texts():
    out = [(k, sentence(RNG.randint(20, 250)) + (" vile" if k % 6 == 0 else "")) for k in range(240)]
    out += [(300 + k, f"{sentence(20)}\n{COMMON[k % 3]}\n\n{sentence(20)}\n{COMMON[2]}") for k in range(15)]
    out += [(330 + k, COMMON[0]) for k in range(3)]  # nothing is left of these
    near = [out[1][1], out[2][1]]
    out += [(400 + k, f"{near[k % 2]} {sentence(3 * k)}") for k in range(4)] + [(410, near[0]), (410, near[0]), (411, near[0]), (None, near[1]), (None, sentence(50) + " only"), (None, near[0])]
    twin = sentence(40)
    out += [(None, twin), (None, twin + " x")]  # a group without any id
    out += [(500 + k, f"{sentence(80)} {t} {sentence(80)}") for k, t in ITEMS] + [(7, sentence(70))]
    return out + [(600, None), (601, ""), (None, None), (602, " \n "), (603, "tiny"), (604, "w " * 20000)]


ROWS = [(i, t, "en" if k % 2 else None, "h", len(t or ""), "n", k, "m", k, "s", k) for k, (i, t) in enumerate(texts())]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(ROWS, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(180)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def staged(spark, sf, k, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    if k < 4:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    return Counter(map(tuple, out.collect()))


def not_toxic(rows):
    return [r for r in rows if "vile" not in (r[1] or "").split()]


def without_common_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    n = Counter(x for _, t in docs for x in {key(x) for x in (t or "").split("\n")} if x)
    seen, kept = set(), {}
    for d in docs:
        lines = []
        for x in (d[1] or "").split("\n"):
            if n[key(x)] < 10 or key(x) not in seen:
                lines.append(x)
            seen.add(key(x))
        kept[d] = None if d[1] is None else "\n".join(lines)
    out = []
    for r in rows:
        t = kept[r[:2]]
        if t == r[1] or t.strip():
            out.append((r[0], t, *r[2:4], len(t) if t is not None else None, *r[5:]))
    return out


def group_of(rows):
    """(rows in groups, as lists of places), by comparing all sets."""
    own = [(k, r[1]) for k, r in enumerate(rows)]
    found = {}
    for (k, n, c), _ in jaccard(own).items():
        if n:
            found.setdefault(c, []).append(k)
    return list(found.values())


def check_near(rows, got):
    """One row of each group stays, one of its smallest doc_id."""
    want = Counter(r for r in rows if not (r[1] or "").split())
    for group in group_of(rows):
        members = [rows[k] for k in group]
        ids = [m[0] for m in members if m[0] is not None]
        stay = [m for m in members if got[m]]
        assert sum(got[m] for m in set(members)) == 1 and stay[0][0] == (min(ids) if ids else None)
        want[stay[0]] += 1
    assert want == got


def not_leaked(rows):
    plain = lambda t: " " + " ".join(decontaminate.plain_words(t)) + " "
    gone = {r[0] for r in rows if any(plain(t) in plain(r[1]) for _, t in ITEMS)}
    return [r for r in rows if r[0] not in gone]


def test_stages(spark, sf):
    rows = ROWS
    assert staged(spark, sf, 0, rows) == Counter(not_toxic(rows))
    rows = not_toxic(rows)
    got = staged(spark, sf, 1, rows)
    n_chars = lambda c: Counter({(*r[:4], r[4] if r[1] is not None else None, *r[5:]): v for r, v in c.items()})
    assert n_chars(got) == Counter(without_common_lines(rows))
    rows = list(got.elements())
    got = staged(spark, sf, 2, rows)
    check_near(rows, got)
    rows = list(got.elements())
    assert staged(spark, sf, 3, rows) == Counter(not_leaked(rows)) and len(not_leaked(rows)) == len(rows) - len(ITEMS)
    last = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(not_leaked(rows), COLUMNS), sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r[0] for r in not_leaked(rows)) and all(r["round_trip"] for r in last)


def test_copy_of_the_rows_holds_each_text_once(spark, sf, monkeypatch):
    size = lambda top: sum(f.stat().st_size for f in Path(top.removeprefix("file://")).rglob("*.parquet"))
    tables, write = {}, corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: tables.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(k, sentence(400), "en", "h") for k in range(300)], "doc_id long, text string, lang string, source string").repartition(3)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).count() == 300
    plain = write(docs, "plain")
    assert size(tables["pipeline-rows"].written) < 1.2 * size(plain.written)


def test_run_keeps_only_the_table_of_the_last_stage(spark, sf, monkeypatch):
    tables, write = {}, corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: tables.setdefault(name, write(df, name)))
    out = corpus_pipeline.run(spark, sf)
    names = [f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES[:-1]]
    assert [n for n in names if Path(tables[n].written.removeprefix("file://")).exists()] == names[-1:]
    assert out.where("round_trip").count() == tables[names[-1]].count() > 0


def test_whole_pipeline(spark, sf):
    rows = without_common_lines(not_toxic(ROWS))
    out = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    kept = [r for r in rows if not (r[1] or "").split()]
    for group in group_of(rows):
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        kept.append(next(rows[k] for k in group if rows[k][0] == (min(ids) if ids else None)))
    assert out == Counter(r[0] for r in not_leaked(kept)) and out[1] == out[2] == 1 and not out[500] and not out[0]


def test_empty_tables(spark, sf, tmp_path):
    for name, table in (("documents", (COLUMNS, [])), ("labels", ("doc_id long, toxic int", [])), ("benchmark", ("item_id long, text string", []))):
        spark.createDataFrame(table[1], table[0]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for k in range(4):
        assert not staged(spark, sf, k, [])
    docs = [r for r in ROWS if r[0] in (0, 1, 500)]
    assert staged(spark, str(tmp_path), 0, docs) == staged(spark, str(tmp_path), 3, docs) == Counter(docs)
