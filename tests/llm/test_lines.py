import random

from helixframe.llm.lines import delete_repeated_lines


def brute(rows, least):
    """The texts that are left, by looking every run of lines up among all earlier places."""
    docs = {}
    for d, t in rows:
        docs.setdefault((2**63 - 1 if d is None else d, t), [x.strip() for x in (t or "").split("\n") if x.strip()])
    order = sorted((k for k in docs if k[1] is not None), key=lambda k: k[0])
    first, gone = {}, {k: set() for k in docs}
    for k in order:
        lines = docs[k]
        for s in range(len(lines)):
            for n in range(1, len(lines) - s + 1):
                run = tuple(lines[s : s + n])
                if sum(len(x.split()) for x in run) >= least:
                    if run in first:
                        gone[k] |= set(range(s, s + n))
                    else:
                        first[run] = (k, s)
    out = []
    for d, t in rows:
        k = (2**63 - 1 if d is None else d, t)
        if t is not None and gone[k]:
            parts, i, kept = t.split("\n"), 0, []
            for x in parts:
                if x.strip():
                    i += 1
                    if i - 1 in gone[k]:
                        continue
                kept.append(x)
            t = "\n".join(kept) if "\n".join(kept).strip() else ""
        out.append((repr(d), repr(t), len(gone[k])))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    pool = ["a b c d e f g h i", "one two three", "x", "y z", "five words are in this", "p q r s t u v w", "éa êb", "m n o p q r"]
    unique = iter(range(10**6))
    rows = []
    for d in range(70):
        lines = [r.choice(pool) if r.random() < 0.75 else f"line {next(unique)} is of its own kind" for _ in range(r.randrange(0, 9))]
        lines = [x + " " * r.randrange(2) for x in lines]
        for _ in range(r.randrange(3)):
            lines.insert(r.randrange(len(lines) + 1), r.choice(("", "  ")))
        rows.append((d, "\n".join(lines)))
    big = "\n".join(f"w{i} of it" for i in range(12))
    return rows + [(100, big), (101, "z\n" + big), (102, None), (103, ""), (None, big), (104, "\n \n"), (100, big), (105, "x\n" * 30), (106, "a b c d e f g h i\n" * 4)]


def test_against_brute_force(spark):
    for seed, least in ((1, 8), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, gone string")
        got = sorted((repr(r.doc_id), repr(r.text), r.n_removed) for r in delete_repeated_lines(df, least).collect())
        assert got == brute(rows, least)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert delete_repeated_lines(df).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert delete_repeated_lines(df).count() == 0
