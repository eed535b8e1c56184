"""Quotation linking against plain Python."""

import random

import regex

from latticeq.llm import quotes

MARKS = regex.compile(r"^(?:[ \t]*>)+")
WROTE = regex.compile(r"(?i)^\s*(?:on|am|le|el)\b.{0,300}:\s*$")


def normal(t):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip(" ")


def units(t):
    parts = [normal(x) for x in regex.split(r"\n\s*\n", t) + t.split("\n")]
    whole = [normal(t)] if normal(t) else []
    return {*whole, *(x for x in parts if len(x.split(" ")) >= 3)}


def parsed(text):
    lines = (text or "").split("\n")
    level = [m[0].count(">") if (m := MARKS.match(x)) else 0 for x in lines]
    body = [x for i, x in enumerate(lines) if not level[i] and not (i + 1 < len(lines) and level[i + 1] and WROTE.match(x))]
    passages = []
    for i, x in enumerate(lines):
        if level[i]:
            bare = MARKS.sub("", x).strip(" ")
            if i and level[i - 1] == level[i]:
                passages[-1][1] += "\n" + bare
            else:
                passages.append([level[i], bare])
    return "\n".join(body).strip(), passages


def brute(rows):
    messages = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            messages.setdefault((conv, turn), []).append(parsed(text))
    replies = {}
    for (conv, turn), versions in messages.items():
        found = []
        for n, version in enumerate(versions):
            for run, (level, passage) in enumerate(version[1]):
                best = []
                for u in units(passage):
                    sources = [t for (c, t), vs in messages.items() if c == conv and any(u in units(b) for b, _ in vs)]
                    if sources and min(sources) < turn:
                        best.append((-level, len(u), min(sources)))
                if best:
                    found.append((run, max(best)))
        if found:
            replies[conv, turn] = (len({r for r, _ in found}), max(b for _, b in found)[2])
    out = []
    for conv, turn, role, text in rows:
        body, passages = parsed(text)
        n, up = replies.get((conv, turn), (0, None)) if conv is not None and turn is not None else (0, None)
        path, at = [turn], up
        while at is not None:
            path.insert(0, at)
            at = replies.get((conv, at), (0, None))[1]
        out.append((conv, turn, role, body, len(passages), n, max([lv for lv, _ in passages], default=0), up, path))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ja", "no", "été", "Zeit", "tea", "run", "42", "o'er", "一二"]) + str(rng.randint(0, 30))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", " ?"])
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randint(1, 9)):
            own = [rng.choice([sentence(), sentence() + "\n" + sentence(), ""]) for _ in range(rng.randint(1, 3))]
            lines = []
            if said and rng.random() < 0.8:
                if rng.random() < 0.5:
                    lines.append(rng.choice(["On Monday, A wrote:", "Am Montag schrieb B:", "Il a dit:"]))
                quoted = rng.choice(said).split("\n")
                quoted = quoted[: rng.randint(1, len(quoted))]
                lines += [rng.choice(["> ", ">", " > "]) + rng.choice([x, x.upper(), x]) for x in quoted]
                if rng.random() < 0.3:
                    lines += [">> " + x for x in rng.choice(said).split("\n")]
            text = "\n".join(lines + ["\n\n".join(own)])
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    common = "The same first turn of many."
    rows += [(100 + i, t, "user", x) for i in range(60) for t, x in enumerate([common, "> " + common + "\nYes it is so."])]
    chain = [(300, t, "user", (f"> message number {t - 1} of the chain\n" if t else "") + f"message number {t} of the chain") for t in range(37)]
    odd = [(None, 0, "user", "a b c"), (None, 1, "user", "> a b c"), (400, None, "user", "> x y z"), (400, 0, None, None), (400, 1, "user", ""), (400, 1, "user", "> x"), (401, 0, "user", "x y z"), (401, 1, "a", "> x y z"), (401, 1, "a", "> x y z"), (402, 0, "user", "w " * 100_000), (402, 1, "user", "> " + "w " * 100_000), (403, 3, "user", "> later text here"), (403, 4, "user", "later text here"), (404, 0, "u", ">>> \n> \n>"), (405, 0, "u", "> self quote now\nself quote now")]
    return rows + chain + odd


def test_links_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn int, role string, text string, body string, level int").repartition(3)
        got = [(r.conv_id, r.turn, r.role, r.body, r.n_passages, r.n_linked, r.max_level, r.reply_to, r.reply_path) for r in quotes.link(df).collect()]
        assert sorted(got, key=str) == brute(rows)
    assert any(len(r[-1]) == 37 for r in got)


def test_registered_query_against_brute_force(spark, tmp_path):
    # The synthetic tables quote nothing, so the query is run over conversations with nested quotes.
    rows = made(3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.conv_id, r.turn, r.role, r.body, r.n_passages, r.n_linked, r.max_level, r.reply_to, r.reply_path) for r in quotes.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sum(r[5] > 0 for r in got) > 100 and max(r[6] for r in got) >= 2


def test_reply_order_and_levels(spark):
    rows = [(1, 0, "user", "First question here?"), (1, 1, "user", "Second question here?"), (1, 2, "assistant", "> First question here?\nAnswer to the first."), (1, 3, "assistant", "On Friday, X wrote:\n> Second  QUESTION here\nAnswer to the second."), (1, 4, "user", "> Answer to the first.\n>> First question here?\nThanks a lot.")]
    got = sorted(quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.reply_path)
    assert [(r.turn, r.body, r.reply_to, r.max_level) for r in got] == [(0, "First question here?", None, 0), (2, "Answer to the first.", 0, 1), (4, "Thanks a lot.", 2, 2), (1, "Second question here?", None, 0), (3, "Answer to the second.", 1, 1)]


def test_sentences_quoted_out_of_paragraphs(spark):
    rows = [
        (1, 0, "user", "I like cats. I also like small dogs."),
        (1, 1, "assistant", "> I also like small dogs.\nSo do I."),
        (2, 0, "user", "A list\nIt holds 3.5 kilos of tea. She said \"We drink it all!\" Nobody\nbelieved a word of it... Was that right?"),
        (2, 1, "assistant", "> Nobody believed\n> a word of it...\nI did."),
        (2, 2, "assistant", "> It holds 3.5 kilos of tea.\nMuch."),
        (2, 3, "assistant", "> She said \"We drink it all!\" Nobody believed a word of it...\nWell."),
        (2, 4, "assistant", "> holds 3.5 kilos\nNo sentence."),
    ]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (0, None), (1, 1): (1, 0), (2, 0): (0, None), (2, 1): (1, 0), (2, 2): (1, 0), (2, 3): (1, 0), (2, 4): (0, None)}


def test_nothing(spark):
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
