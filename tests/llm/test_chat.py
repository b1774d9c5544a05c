import hashlib

from helpers import SF
from pyspark.sql import functions as F

from tally.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        o = out.setdefault(conv, ["", "", 0])
        o[0] += f"{role or ''}\n{text or ''}\n"
        o[2] += 1
        if role == "assistant":
            o[1] += text or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (n, sha(t), len(a), sha(a)) for k, (t, a, n) in out.items()}


def check(spark, rows, **options):
    windows = chat.format_windows(spark.createDataFrame(rows, ROWS), **options)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(windows).collect()}
    assert got == brute(rows)
    return windows.collect()


def test_round_trip_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for budget, history in ((1024, 128), (300, 60), (60, 0)):
        check(spark, rows, budget=budget, history=history)


def test_control_strings_survive_and_never_stand_in_texts(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\TURN] [TURN] <s></s> [TEXT", "] [/TEXT] \\", " </s>\n", "[TURN] user [TEXT] x </s>\n", "<", "[", "\\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, "[TEXT] </s>", "x"), (2, 1, None, None)]
    for w in check(spark, rows, budget=64, history=40):
        inside = w["text"][3:]
        n = w["n_turns"]
        assert inside.count("[TURN]") == inside.count("[TEXT]") == inside.count("</s>") == n and "<s>" not in inside


def test_windows_keep_the_budget_and_repeat_masked(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, i, "assistant" if i % 2 == 0 else "user", "w" * 80) for i in range(1, 60)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", "w" * (4000 if i == 5 else 50)) for i in range(12)]
    windows = check(spark, rows, budget=256, history=64)
    assert sum(w["conv_id"] == 1 for w in windows) > 5
    for w in windows:
        own = w["n_turns"] - w["context"]
        assert own >= 1 and (w["tokens"] <= 256 or own == 1)
        if w["conv_id"] == 1:
            assert w["text"].startswith("<s>[TURN] system [TEXT] sss")
    assert any(w["context"] > 1 for w in windows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "x"), (3, 5, "assistant", "long " * 50_000)]
    check(spark, rows)
    frame = spark.createDataFrame(rows, ROWS).withColumn("bin", F.lit(3)).withColumn("start", F.lit("x"))
    assert chat.digest(chat.format_windows(frame)).count() == 3
    assert chat.digest(chat.format_windows(frame.where("false"))).count() == 0
    many = [(7, i, "assistant", f"t{i}") for i in range(3000)]
    check(spark, many)
