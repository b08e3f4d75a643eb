"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import random

WORDS = [a + b for a in "ka lo mi nu re sa to vi".split() for b in "ban del fis gor han jul pem".split()]
KINDS = ("doc_id long, text string, lang string, source string, n_chars long, score double, words string, fp long, key string, "
         "component_id long, found int, chunk long")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list[tuple]:
    passage, line = prose(900, 70), "This very line stands in many documents, word for word."
    near = prose(901, 400).split()
    out = [(i, prose(i, 20 + 7 * i)) for i in range(12)]
    out += [(20, passage), (21, prose(21, 30) + " " + passage), (22, passage + "\n" + prose(22, 40)), (23, passage)]
    out += [(30, " ".join(near)), (31, " ".join(near[:200] + ["changed"] + near[201:])), (32, " ".join(near).upper())]
    out += [(40 + i, prose(40 + i, 25) + "\n" + line + "\n\n" + prose(60 + i, 15)) for i in range(6)]
    out += [(50, line + "\n" + line.replace("many", "some") + "\n" + line.upper()), (51, None), (52, ""), (53, "   \n\n "), (54, "one"),
            (55, "x " * 3000), (56, prose(56, 9000)), (57, "aé中🙂 b́ ÀÉ" * 9), (58, "ab" * 700), (59, "naïve\x85café x")]
    out += [(None, prose(3, 41)), (None, "no id " + prose(77, 60)), (60, "same id one"), (60, "same id two " + passage), (20, passage)]
    return out


def frame(spark, rows=None, kinds=KINDS):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "w", 7, "k", 9, 1, 2) for i, t in rows], kinds).repartition(3)


def empty(spark):
    return spark.createDataFrame([], KINDS)
