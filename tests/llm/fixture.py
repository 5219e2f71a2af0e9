"""Rows with every oddity the operators define a result for."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, slot int, label string"
_SYLLABLES = ["the", "on", "er", "tion", "ing", "é", "st", "ou", "ñ", "ber", "an", "re"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(word + (".\n" if i % 11 == 10 else ""))
    return " ".join(out)


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = "changed%d" % p
    return " ".join(words)


def texts() -> list[str | None]:
    base, long = prose(1, 150), prose(2, 6000)
    return [
        base,
        base,
        edited(base, [20]),
        edited(base, [60, 110]),
        edited(base, [5, 40, 70, 100, 130]),
        prose(3, 150),
        prose(4, 80) + "\n" + "same line again.\n" * 12,
        "",
        "   \n\t ",
        None,
        None,
        "one two three",
        "one two three",
        "¡ÑANDÚ! ünï 中文 \U0001f642 <s>[INST] x\\y [/INST] </s>",
        long,
        edited(long, [17, 900]),
        "mail bob@site.example.org or 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 x +1 (456) 555-2186 tel 030 123-4567",
        "iban GB82WEST12345698765432 and GB82WEST12345698765433",
        "word",
    ]


def rows() -> list[tuple]:
    out = [(i, t, ["en", "de", None][i % 3], [None, "src0", "src1"][i % 3], None if t is None else len(t), 5, 1, "x") for i, t in enumerate(texts())]
    out.append(out[0])  # a repeated row
    out.append((None, texts()[0], None, None, None, None, None, None))
    out.append((None, "text without an id", "en", "src0", 1, None, None, None))
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def folder(tmp_path, spark, **tables) -> str:
    """Tables as a query finds them."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
