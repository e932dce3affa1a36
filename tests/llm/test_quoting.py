import random
import re

import pandas as pd

from hearthline.llm import quoting


def test_passages():
    assert quoting.passages("hi\n> a\n>> b\n> > c\nbye") == [(0, ["hi"]), (1, ["a"]), (2, ["b", "c"]), (0, ["bye"])]
    assert quoting.passages("Ann wrote:\n> a") == [(0, []), (1, ["a"])]
    got = quoting.parse(pd.Series(["x y z\n\nAnn wrote:\n> The  Words, here\nreply", None, "", "> only"]))
    assert got["clean"].tolist() == ["x y z\nreply", "", "", ""]
    assert [len(q) for q in got["quoted"]] == [1, 0, 0, 1]
    assert got["quoted"][0][0]["whole"] == quoting.key("the words here")


ROWS = [
    (1, 0, "user", "How does this work?\nPlease tell me more."),
    (1, 1, "assistant", "It works by itself."),
    (1, 2, "user", "> It works by itself.\nReally?"),
    (1, 3, "assistant", "Bob wrote:\n>> It works by itself.\n> Really?\nYes."),
    (1, 4, "user", "> please tell me MORE\nAnd this?"),
    (1, 5, "user", "> never said before\nHm."),
    (1, 6, "user", "> hm\nok"),
    (2, 0, "user", "> It works by itself.\nOther place."),
    (2, 0, "user", "> It works by itself.\nOther place."),
    (None, 1, "user", "> x y z\nlost"),
    (3, None, None, None),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, thread_turn string")
    out = quoting.link_quotes(df)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    got = {(r["conv_id"], r["turn"]): (r["text"], r["parent_turn"], r["thread_turn"], r["n_quotes"], r["n_linked"]) for r in rows}
    assert got[1, 2] == ("Really?", 1, 1, 1, 1)
    assert got[1, 3] == ("Yes.", 2, 1, 2, 2)
    assert got[1, 4] == ("And this?", 0, 0, 1, 1)
    assert got[1, 5] == ("Hm.", None, 5, 1, 0)
    assert got[1, 6] == ("ok", 5, 5, 1, 1)
    assert got[2, 0] == ("Other place.", None, 0, 1, 0)
    assert got[None, 1] == ("lost", None, 1, 1, 0) and got[3, None] == ("", None, None, 0, 0)
    assert quoting.link_quotes(df.limit(0)).count() == 0


def plain(rows):
    """The same in plain Python: rows are (conv, turn, text), turns are distinct."""
    norm = lambda p: " ".join(x for x in (w.strip(".,;:!?\"'()") for w in p.casefold().split()) if x)
    parsed = {}
    for conv, turn, text in rows:
        runs = []
        for line in text.split("\n"):
            m = re.match(r"[ \t]*>([ \t]?>)* ?", line)
            depth, rest = (m.group().count(">"), line[m.end() :]) if m else (0, line)
            if runs and runs[-1][0] == depth:
                runs[-1][1].append(rest)
            else:
                runs.append((depth, [rest]))
        for k in range(len(runs) - 1):
            if runs[k][0] == 0 and runs[k][1] and runs[k][1][-1].endswith("wrote:"):
                runs[k][1].pop()
        says = [x for d, x in runs if d == 0]
        own = {norm("\n".join("\n".join(x) for x in says))} | {norm("\n".join(x)) for x in says} | {norm(y) for x in says for y in x if len(y.split()) >= 3}
        parsed[conv, turn] = ("\n".join("\n".join(x) for x in says if x).strip("\n") if any(d for d, _ in runs) else text, own - {""}, [(d, norm("\n".join(x)), [norm(y) for y in x if len(y.split()) >= 3]) for d, x in runs if d and norm("\n".join(x))])
    out = {}
    for (conv, turn), (clean, _, quoted) in parsed.items():
        first = lambda k, conv=conv: min((t for (c, t), (_, own, _) in parsed.items() if c == conv and k in own), default=10**9)
        whole = [first(k) for d, k, _ in quoted if d == 1 and first(k) < turn]
        lines = [first(x) for d, _, xs in quoted if d == 1 for x in xs if first(x) < turn]
        out[conv, turn] = [clean, max(whole) if whole else max(lines + whole) if lines else None]
    for conv, turn in out:
        root = turn
        while out[conv, root][1] is not None:
            root = out[conv, root][1]
        out[conv, turn].append(root)
    for conv in {c for c, _ in out}:
        for k, (_, turn) in enumerate(sorted((v[2], t) for (c, t), v in out.items() if c == conv)):
            out[conv, turn].append(k)
    return {k: tuple(v) for k, v in out.items()}


def test_made_up_threads_against_plain_python(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for conv in range(12):
        said = []
        for turn in range(60 if conv == 0 else rng.randrange(1, 12)):
            lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 4))]
            text = "\n".join(lines)
            if said and rng.random() < 0.7:
                old, quoted = rng.choice(said), ""
                cited = old[1] if rng.random() < 0.6 else [rng.choice(old[1])]
                quoted = "\n".join("> " + (x.upper() if rng.random() < 0.3 else x) for x in cited)
                if rng.random() < 0.3:
                    quoted = "\n".join(">> " + x for x in rng.choice(said)[1]) + "\n" + quoted
                text = ("Ann wrote:\n" if rng.random() < 0.4 else "") + quoted + "\n" + text
            said.append((turn, lines))
            rows.append((conv, turn, text))
    out = quoting.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["text"], r["parent_turn"], r["thread_turn"], r["position"]) for r in out}
    want = plain(rows)
    assert got == want and sum(v[1] is not None for v in want.values()) > 50


def test_long_chain(spark):
    rows = [(1, 0, "line number zero here")] + [(1, k, f"> line number {_name(k - 1)} here\nline number {_name(k)} here") for k in range(1, 40)]
    out = quoting.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert {(r["parent_turn"], r["thread_turn"]) for r in out.where("turn > 0").collect()} == {(k, 0) for k in range(39)}


def _name(k):
    return "zero" if k == 0 else f"n{k}"


def test_query(spark, sf):
    source = spark.read.parquet(f"{sf}/conversations.parquet")
    out = quoting.op5_quote_chat(spark, sf)
    want = sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in source.collect())
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in out.collect()) == want  # no message there quotes
