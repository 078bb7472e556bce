import random
from collections import Counter, defaultdict

import pytest

from rasterloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string, h long"


def run(spark, rows):
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in quotes.link_quotes(table).collect()}


def test_levels():
    assert quotes.levels("a\n> b\n>c\n> > d\ne") == [(0, "a"), (1, "b\nc"), (2, "d"), (0, "e")]


def test_links_and_order(spark):
    got = run(spark, [
        (1, 0, "user", "Hello there.\nHow ARE you?"), (1, 1, "assistant", "Fine, thanks."), (1, 2, "user", "> how are  you?\nStill asking."),
        (1, 5, "assistant", "> > hello there.\n> Still asking.\nOk."), (1, 6, "user", "no quote"), (2, 0, "user", ">Fine, thanks.\nfrom elsewhere"), (2, 1, "user", "> never said\nx"),
    ])
    a = got[1, 2]
    assert (a.text, a.reply_turn, a.quoted_conv, a.quoted_turn, a.n_quotes, a.n_linked) == ("Still asking.", 0, 1, 0, 1, 1)
    b = got[1, 5]
    assert (b.text, b.reply_turn, b.n_quotes, b.n_linked) == ("Ok.", 2, 2, 2)
    assert got[1, 6].reply_turn == 5 and got[1, 0].reply_turn is None and got[1, 1].reply_turn == 0
    c = got[2, 0]
    assert (c.reply_turn, c.quoted_conv, c.quoted_turn, c.text) == (None, 1, 1, "from elsewhere")
    assert (got[2, 1].n_quotes, got[2, 1].n_linked, got[2, 1].reply_turn) == (1, 0, 0)
    assert got[1, 1].chat == "<|assistant|>\nFine, thanks.\n"
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: (-1 if r.reply_turn is None else r.reply_turn, r.turn))
    seen = set()
    for r in order:
        assert r.reply_turn is None or r.reply_turn in seen
        seen.add(r.turn)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ""), (None, 3, "user", "> a"), (2, None, "user", "a"), (3, 0, "user", "a\n" * 3000 + "> a"), (3, 1, "user", ">"), (3, 1, "user", "> a")]
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert quotes.link_quotes(table).count() == len(rows)
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(rows):
    """Every quote looked up among all messages: the run before its first line, the own conversation before others."""
    said = defaultdict(set)
    parsed = []
    for c, t, _, text in rows:
        runs = quotes.levels(text or "")
        own = [x for level, x in runs if level == 0]
        body = "\n".join(own).strip("\n")
        parsed.append((c, t, body, [(level, i, x) for i, (level, x) in enumerate(runs) if level and norm(x)]))
        if c is not None and t is not None:
            for x in [body, *own, *(line for o in own for line in o.split("\n"))]:
                if norm(x):
                    said[norm(x)].add((c, t))
    out = []
    for c, t, body, asked in parsed:
        links = []
        for level, i, x in asked:
            for key in (norm(x), next(norm(line) for line in x.split("\n") if norm(line))):
                places = said[key]
                here = [b for a, b in places if t is not None and a == c and b < t]
                there = [p for p in places if c is None or t is None or p[0] != c]
                if here or there:
                    links.append((not here, level, i, (c, max(here)) if here else min(there)))
                    break
        best = min(links)[3] if links else (None, None)
        known = links and not min(links)[0]
        before = [b for a, b, *_ in rows if a == c and b is not None and t is not None and c is not None and b < t]
        out.append((c, t, body, best[1] if known else max(before, default=None), *best, len(asked), len(links)))
    return Counter(out)


def norm(x):
    return " ".join(x.lower().split())


def threads(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 5))) for _ in range(25)] + ["common line"]
    rows = []
    for c in range(12):
        turn, said = 0, []
        for _ in range(rng.randrange(1, 25)):
            parts = []
            for _ in range(rng.randrange(3)):
                source = rng.choice(said or [rng.choice(lines)]) if rng.random() < 0.7 else rng.choice(lines)
                parts += [rng.choice([">", "> ", ">> ", "> > "]) + x for x in source.split("\n")]
            parts += rng.choices([*lines, "", "  Common   LINE"], k=rng.randrange(4))
            text = "\n".join(parts)
            said.append(text)
            rows.append((c, turn, "user", text))
            turn += rng.choice([1, 1, 1, 2, 9000])
    return rows + [(None, 3, "user", "> common line"), (4, None, "user", "> common line\nx"), (None, None, None, None), (5, 0, "user", "> common line"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_messages(spark, seed):
    rows = threads(seed)
    got = quotes.link_quotes(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert Counter((r.conv_id, r.turn, r.text, r.reply_turn, r.quoted_conv, r.quoted_turn, r.n_quotes, r.n_linked) for r in got) == brute(rows)
    by = defaultdict(list)
    for r in got:
        assert (r.position is None) == (r.conv_id is None)
        if r.conv_id is not None:
            by[r.conv_id].append(r)
    for held in by.values():
        held.sort(key=lambda r: r.position)
        assert [r.position for r in held] == list(range(len(held)))
        at = [(r.reply_turn is not None, r.reply_turn or 0, r.turn is not None, r.turn or 0) for r in held]
        assert at == sorted(at)


def test_own_words_repeated_are_found_elsewhere(spark):
    got = run(spark, [(1, 1, "user", "> lost words\nlost words"), (2, 0, "user", "lost words"), (3, 4, "user", "lost words"), (3, 5, "user", "> lost words")])
    assert (got[1, 1].quoted_conv, got[1, 1].quoted_turn, got[1, 1].n_linked) == (2, 0, 1)
    assert (got[3, 5].quoted_conv, got[3, 5].quoted_turn, got[3, 5].reply_turn) == (3, 4, 4)


def test_registered_query(spark, tmp_path):
    rows = threads(3)
    spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = quotes.op4_quotes(spark, str(tmp_path)).collect()
    assert Counter((r.conv_id, r.turn, r.text, r.reply_turn, r.quoted_conv, r.quoted_turn, r.n_quotes, r.n_linked) for r in got) == brute(rows)
