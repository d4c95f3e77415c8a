"""Small made-up tables for the tests of this folder."""

import random

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ren", "sul", "pe", "dor", "vi", "na", "gol"],
    "bb": ["sch", "ein", "ber", "ung", "keit", "zu", "ach", "pf", "stö", "ge"],
    "cc": ["eau", "ment", "que", "oi", "ré", "aux", "ille", "tre", "ou", "pa"],
}


def word(rng: random.Random, lang: str = "aa") -> str:
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4)))


def prose(rng: random.Random, n: int, lang: str = "aa") -> str:
    return " ".join(word(rng, lang) for _ in range(n))


def junk(rng: random.Random, n: int) -> str:
    return " ".join(word(rng).upper() + rng.choice(["!!", "$$$", "***", "%%%"]) for _ in range(n))


#: Columns that operators use themselves come along as extra ones.
CLASHING = ("bucket", "tokens", "rep", "a", "h", "weight", "keep", "shard", "score", "text_", "n", "label", "group_id", "lost")


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(*r, "aa")[:3] for r in rows]
    data = [(i, t, lang, "src0", None if t is None else len(t), *(["x"] * len(CLASHING) if clashing else [])) for i, t, lang in full]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if clashing:
        schema += "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame(data, schema)


#: Nulls, blanks, ties, repeated rows and a long text.
def awkward(long_words: int = 30_000):
    rng = random.Random(8)
    same = prose(rng, 60)
    return [
        (None, "no id here but some words"),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, same),
        (4, same),
        (5, same),
        (6, "!!! ... ???"),
        (7, prose(rng, long_words)),
        (8, "x" * 200_000),
        (9, "one"),
    ]
