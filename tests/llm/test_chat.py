from tallyloom.llm import chat


def brute(rows):
    """conv -> (turns, copies, rendered) of maximal conversations."""
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(set(v))] for c, v in convs.items()}
    lists = {c: tuple(v) for c, v in convs.items()}
    prefixes = {v[:n] for v in lists.values() for n in range(1, len(v))}
    out = {}
    for c, v in lists.items():
        same = [x for x in lists if lists[x] == v]
        if v not in prefixes and c == min(same, key=lambda x: (x is None, x)):
            out[c] = (len(v), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v))
    return out


def collapsed(df):
    out = {}
    for r in sorted(chat.collapse(df).collect(), key=lambda r: r.segment):
        turns, copies, text = out.get(r.conv_id, (r.turns, r.n_copies, ""))
        out[r.conv_id] = (turns, copies, text + r.rendered)
    return out


def test_against_brute_force(spark):
    rows = []
    for c in range(60):
        for t in range(1 + c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {t} of {c % 5}" if t < 4 else f"end {c}"))
    rows += [(100, 0, None, None), (100, None, "user", "first"), (101, 5, "user", "late"), (101, 5, "user", "later"), (None, 0, "user", "no id"), (None, 1, "user", "still none")]
    rows += rows[:9]
    long = [(200, t, "user", f"x{t}") for t in range(700)] + [(201, t, "user", f"x{t}") for t in range(600)]
    df = spark.createDataFrame(rows + long, "conv_id bigint, turn bigint, role string, text string")
    assert collapsed(df) == brute(rows + long)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("block", "position", "a", "h", "n", "offset", "last")])
    assert collapsed(extra) == collapsed(df) and set(collapsed(df)) == {1}
    assert chat.collapse(df.where("false")).count() == 0


def test_turns_that_only_look_alike(spark):
    rows = [(1, 0, "a\nb", "c"), (2, 0, "a", "b\nc"), (3, 0, "a", "b"), (3, 1, "c", ""), (4, 0, "a", "bc"), (5, 0, "ab", "c"), (6, 0, "1:a", "b"), (7, 0, "1", ":ab")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert collapsed(df) == brute(rows) and len(collapsed(df)) == 7


def test_very_long_texts_and_many_rows_of_one_turn(spark):
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, "bot", "x"), (2, 0, "user", "long " * 200_000)]
    rows += [(None, t % 3, "user", f"{t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert collapsed(df) == brute(rows)
