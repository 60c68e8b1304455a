"""Chat formatting and fill-in-middle against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat_format as cf
from linkloom.llm import fill_middle as fm
from linkloom.llm import queries

CHATS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chat_rows():
    rng = random.Random(3)
    bits = ["\\", "### ", "### assistant: ", "</turn>", "</turn>\n", "<next/>", ": ", ":", "<", "#", "é", "日🙂", "ok ", "\n"]
    rows = [
        (c, rng.choice([None] + [t] * 12), rng.choice(["user", "assistant", "assistant", "system", None, "a: b", "</turn>"]), rng.choice([None] + ["".join(rng.choices(bits, k=rng.randrange(9)))] * 5))
        for c in [None, *range(50)] for t in range(rng.randrange(1, 25))
    ]
    return rows + [(777, 5, "user", f"x{i % 7}") for i in range(40)] + [(778, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(300)]


def plain_chats(rows):
    groups = {}
    for c, t, r, x in rows:
        key = (t is not None, t or 0, cf._plain_escaped(r or "").encode(), cf._plain_escaped(x or "").encode())
        groups.setdefault(c, []).append((key, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(x for _, r, x in turns if r == "assistant")
        text, before = "", None
        for _, r, x in turns:
            text += ("<next/>" if r == before else ("</turn>\n" if before is not None else "") + f"### {cf._plain_escaped(r)}: ") + cf._plain_escaped(x)
            before = r
        out[c] = len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said), text + "</turn>\n"
    return out


@pytest.mark.parametrize(("stretch", "most"), [(128, 4096), (4, 6)])
def test_chats_equal_the_plain_version(spark, monkeypatch, stretch, most):
    monkeypatch.setattr(cf, "STRETCH", stretch)
    monkeypatch.setattr(cf, "MOST", most)
    rows = chat_rows()
    made = cf.format_chats(spark.createDataFrame(rows, CHATS).withColumns({c: F.lit(1) for c in ("_at", "loss", "formatted", "first", "n")}))
    texts, read = {r.conv_id: r for r in made.collect()}, {r.conv_id: r for r in cf.read_back(made).collect()}
    want = plain_chats(rows)
    assert set(texts) == set(read) == set(want)
    for c, (n, turns, chars, said, text) in want.items():
        r = read[c]
        assert texts[c].formatted == text and r.formatted_chars == len(text), c
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, turns, chars, said), c
        data = text.encode()
        assert all(data[s.start - 2 : s.start] in (b": ", b"/>") for s in texts[c].loss)


def test_only_expressions(spark):
    plan = cf.read_back(cf.format_chats(spark.createDataFrame(chat_rows(), CHATS)))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "PythonUDF" not in plan and "collect_list" in plan


def test_no_chats(spark):
    empty = spark.createDataFrame([], CHATS)
    assert cf.read_back(cf.format_chats(empty)).count() == 0
    none = cf.read_back(cf.format_chats(spark.createDataFrame([(1, None, None, None)], CHATS))).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars) for r in none] == [(1, sha("\n\n"), 0)]


def test_tricky_conversation(spark):
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()}
    said = "\\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))


def plain_middle(doc_id, text, marks=fm.SENTINELS, percent=100, spm=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in marks) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form, (x, y, z) = ("spm" if h4 % 100 < spm else "psm"), marks
    return n, form, len(p), len(m), y + s + x + p + z + m if form == "spm" else x + p + y + s + z + m


def middle_rows():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "\n", "é", "日🙂", "<", "P>", ">", " ", "<S", "M>"], k=rng.randrange(30))) for _ in range(400)]
    texts += ["", "\n", "\n\n\n", "x", "a<M>b\n", "line\n" * 40_000 + "end", "é" * 200_000]
    return list(enumerate(texts))


@pytest.mark.parametrize(("marks", "percent", "spm"), [(fm.SENTINELS, 100, 50), (("<|prefix|>", "⟨S⟩", "<|m|>"), 60, 30)])
def test_middles_equal_the_plain_version(spark, marks, percent, spm):
    rows = middle_rows()
    df = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("form", "output", "restored", "_h", "extra")})
    made = fm.restored(fm.fill_in_middle(df, sentinels=marks, percent=percent, spm_percent=spm), marks)
    got = {r.doc_id: r for r in made.collect()}
    assert len(got) == len(rows) + 1 and got[None].form == "plain" and got[None].extra == "extra"
    for i, text in rows:
        n, form, p, m, out = plain_middle(i, text, marks, percent, spm)
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars) == (n, form, p, m), i
        assert bytes(got[i].output).decode() == out and bytes(got[i].restored).decode() == text, i


def test_middles_of_odd_rows(odd, none):
    made = fm.restored(fm.fill_in_middle(odd))
    assert made.count() == odd.count() and fm.restored(fm.fill_in_middle(none)).count() == 0
    bad = odd.join(made.select("doc_id", "restored").distinct(), "doc_id").where(F.coalesce("text", F.lit("")) != F.col("restored").cast("string"))
    assert bad.count() == 0


def test_reversal_by_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(fm, "_SWAP", 3)
    for n in range(30):
        for i in range(0, n, 3):
            a = np.arange(n)
            fm.exchange(a, i, (i + n) // 2, n)
            assert a.tolist() == [*range(i), *range((i + n) // 2, n), *range(i, (i + n) // 2)]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "<S>", "<M>"), ("<P>", "<<P>>", "x"), ("", "a", "b"), ("a\n", "b", "c")])
def test_bad_sentinels(marks):
    with pytest.raises(ValueError):
        fm.checked(marks)
