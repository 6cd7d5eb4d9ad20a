from resonara.llm.chat import format_preferences, swapped_answers

SCHEMA = "conv_id long, turn long, role string, text string, prompt string, t0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def show(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_prefix_completions_and_masks(spark):
    a = frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "Ünd so"), (2, 0, "user", "same"), (3, 0, "user", "only here"), (4, 0, None, None), (4, 1, "assistant", "a"), (5, 0, "user", "q"), (5, 1, "assistant", "long"), (None, 0, "user", "z")])
    b = frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (4, 0, "user", ""), (5, 0, "user", "q"), (6, 0, "user", "x"), (None, 0, "user", "z")])
    got = {r.conv_id: r for r in format_preferences(a, b).collect()}
    assert set(got) == {1, 2, 4, 5}
    r = got[1]
    assert r.n_prompt_turns == 1 and r.prompt == show([("user", "hi")])
    assert r.chosen == show([("assistant", "yes"), ("user", "more"), ("assistant", "Ünd so")]) and r.rejected == show([("assistant", "no")])
    spans = [tuple(map(int, s.split("-"))) for s in r.chosen_mask.split(",")]
    assert [r.chosen[s:e] for s, e in spans] == ["yes<|end|>", "Ünd so<|end|>"]
    s, e = map(int, r.rejected_mask.split("-"))
    assert r.rejected[s:e] == "no<|end|>"
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_mask, got[2].n_prompt_turns) == (show([("user", "same")]), "", "", "", 1)
    assert got[4].n_prompt_turns == 0 and got[4].chosen.startswith("<|unknown|>\n<|end|>")
    assert got[5].n_prompt_turns == 1 and got[5].rejected == "" and got[5].rejected_mask == ""


def test_against_brute_force_and_edges(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"say {(c * t) % 3}") for c in range(30) for t in range(c % 6)] + [(40, 0, "user", "x" * 100_000), (40, 1, "assistant", "y" * 100_000)]
    a = frame(spark, rows)
    b = swapped_answers(a)
    by = lambda df: {k: [(r.role, r.text) for r in sorted(df.collect(), key=lambda r: r.turn) if r.conv_id == k] for k in {r.conv_id for r in df.collect()}}
    ca, cb = by(a), by(b)
    for k, turns in ca.items():
        last = max([i for i, (role, _) in enumerate(turns) if role == "assistant"], default=None)
        if last is None:
            assert cb[k] == turns
        else:
            after = min((x for x in ca if x > k), default=None)
            nxt = [t for role, t in ca.get(after, []) if role == "assistant"]
            assert cb.get(k, []) == turns[:last] + ([("assistant", nxt[-1])] if nxt else [])
    for r in format_preferences(a, b).collect():
        x, y = ca[r.conv_id], cb[r.conv_id]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, show(x[:n]), show(x[n:]), show(y[n:]))
    assert format_preferences(a.limit(0), b).count() == 0
    twice = frame(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")])
    assert format_preferences(twice, twice).first().prompt == show([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_identifiers_of_any_type_and_gaps(spark):
    says = [("b", 0, "user", "q"), ("b", 1, "assistant", "of b"), ("d", 0, "user", "q"), ("d", 1, "assistant", "of d"), ("d", 2, "user", "bye"), ("a", 0, "user", "q"), ("a", 1, "assistant", "of a"), ("e", 0, "user", "alone"), (None, 0, "user", "z")]
    df = spark.createDataFrame(says, "conv_id string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.text for r in swapped_answers(df, part_rows=2).collect()}
    assert got == {("a", 0): "q", ("a", 1): "of b", ("b", 0): "q", ("b", 1): "of d", ("d", 0): "q", ("e", 0): "alone"}
    assert {r.conv_id for r in format_preferences(df, swapped_answers(df)).collect()} == {"a", "b", "d", "e"}
    gaps = spark.createDataFrame([(10, 0, "assistant", "x"), (700, 0, "assistant", "y"), (700, 0, "assistant", "z"), (700, None, "assistant", "w")], "conv_id int, turn long, role string, text string")
    assert sorted((r.conv_id, -1 if r.turn is None else r.turn, r.text) for r in swapped_answers(gaps).collect()) == [(10, 0, "z"), (700, -1, "w")]
    assert swapped_answers(df.limit(0)).count() == 0
