"""Small tables with the odd cases that every text operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start string, key string, place int"


def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "räksmörgås", "naïve", "東京", "x1", "42", "don't", "e-mail"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [line(12), line(60), line(9), line(25)]
    out = []
    for i in range(40):
        lines = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines[1:1] = shared[:3]
        if i % 5 == 0:
            lines.append(shared[3])
        out.append((i, "\n".join(lines)))
    out += [(50, out[7][1]), (51, out[7][1]), (52, out[8][1].replace("alpha", "omega", 1)), (7, out[7][1])]  # copies, a near copy, a repeated row
    out += [(60, None), (61, ""), (62, "   "), (63, "\n\n\n"), (64, "!!! ???"), (None, line(30)), (65, "a"), (66, "a a a a a a a a a"), (67, " lead and  gap\n trail \t"), (68, "end\n")]
    out += [(7, line(20)), (70, "z" * 5000), (71, line(4000)), (72, "z" * 4990 + "y" * 300)]
    return [(i, t, None if i is None or i % 9 == 0 else ("en", "fr")[i % 2], f"src{(i or 0) % 3}", len(t or ""), "s", "k", 1) for i, t in out]


def table(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)


def texts(made=None):
    return [(r[0], r[1]) for r in (rows() if made is None else made)]
