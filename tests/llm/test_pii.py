"""Base spans against brute force, and discovery of identifiers from contexts."""

import hashlib
import random
import re

from sluicegate.llm import pii_bootstrap as pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans int, `left` string")
    return {r["doc_id"]: r for r in pii.extract(docs).collect()}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "@", "..", ".", "1.2.3.4", "0001.002.3.255", "256.1.1.1", "1..2", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "5", " ", "-", "+1 (743) 555-3824", "+49", "(", ")", "é", "漢😀", "\n", "word", "4785380592391139", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(200)] + [None, "", "1 " * 30000, "1-" * 300, "a." * 20000 + "b@" + "c." * 20000 + "d", "9" * 50000, "+" + "1 " * 20000, "11  " * 500, "a@b.c_d@e.f"]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["base"] == want, t
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(s.startswith(k) for s in want.split(",")) for k in FORMS], t


def test_query_has_the_columns_of_its_contract(spark, tmp_path):
    rng = random.Random(4)
    parts = ["a@b.c", "x@y.example", "10.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "plain", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op5_pii(spark, str(tmp_path)).collect():
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in FORMS] == [len(re.findall(f"(?:^|,){k}:", want)) for k in FORMS]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r["spans"].split(","))


def test_long_words_are_contexts(spark):
    word = "b" * 300
    seeds = [f"w{i} {'a' * 200} {word}, +1 (5{i}2) 555-01{i:02d} {word}c now" for i in range(10, 40)]
    got = run(spark, [*seeds, f"hello {'a' * 200} {word}: 55501-2345x", f"hello {'a' * 201} {word}: 55501-2345x"])
    assert got[30]["spans"] == f"phone:{6 + 200 + 303}:{6 + 200 + 303 + 11}" and got[31]["spans"] == ""


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"w{i} please call me at +1 (5{i}2) 555-01{i:02d} now" for i in range(10, 40)]
    texts = [*seeds, "hello please call me at 55501-2345x now", "unrelated 99887-7766 words", "plain text without any number"]
    got = run(spark, texts)
    assert got[30]["spans"] == "phone:24:35" and got[30]["base"] == ""
    assert got[31]["spans"] == got[32]["spans"] == ""
    assert all(got[i]["spans"] == got[i]["base"] != "" for i in range(30))


def test_contexts_discover_other_forms(spark):
    phones = [f"w{i} please call me at +1 (5{i}2) 555-01{i:02d} now" for i in range(10, 60)]
    mails = [f"w{i} kindly write to a{i}@mail{i}.example soon" for i in range(10, 60)]
    odd = ["call me at 555 123 4567 now", "me at 3782 8224 6310 005 now", "call me at (555) 123-4567.", "please write to john(at)mail.example soon", "kindly write to user@localhost soon", "kindly write to jane [at] mail [dot] example soon", "in 555 123 4567 years", "so user@localhost said", "1(" * 20000, " " * 40000 + "1", "(" * 20000 + "12", ":" * 20000 + "1:1"]
    got = run(spark, [*phones, *mails, *odd])
    found = [got[100 + k]["spans"] for k in range(len(odd))]
    assert set(found[6:]) == {""}
    want = [("phone", "555 123 4567"), ("phone", "3782 8224 6310 005"), ("phone", "(555) 123-4567"), ("email", "john(at)mail.example"), ("email", "user@localhost"), ("email", "jane [at] mail [dot] example")]
    assert found[:2] + found[3:6] == [f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for (k, x), t in list(zip(want, odd))[:2] + list(zip(want, odd))[3:]]
    assert found[2] == "phone:11:25" and all(got[i]["spans"] == got[i]["base"] != "" for i in range(100))


def test_found_identifiers_support_patterns(spark):
    seeds = [f"please call me at +1 (5{i}2) 555-01{i:02d} now" for i in range(10, 90)]
    step = [f"please call me at 55{i}-7788x now" for i in range(10, 22)] + [f"my pager line 55{i}-7788x beeps" for i in range(10, 22)]
    texts = [*seeds, *step, "my pager line 99887-123y beeps", "our other 99887-123z words"]
    got = run(spark, texts)
    assert got[len(texts) - 2]["spans"] == "phone:14:24" and got[len(texts) - 1]["spans"] == ""


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.extract(docs).collect() == []
    twice = spark.createDataFrame([(1, "ip 1.2.3.4"), (1, "ip 1.2.3.4"), (None, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["base"]) for r in pii.extract(twice).collect()) == [(0, ""), (1, "ip:3:10"), (1, "ip:3:10")]
