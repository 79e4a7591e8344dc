"""Small document tables with everything that may go wrong in one."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, length string, fp string, spans string"


def docs(spark, rows, parts=2):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "f", "g") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 3000
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "Tie two three four"),
    (6, "tie two three four"),
    (7, LONG),
    (8, "x" * 30_000),
    (9, "naïve Ünï ﬁ 中文 😀   é é\n\nend"),
    (9, "naïve Ünï ﬁ 中文 😀   é é\n\nend"),
    (None, "no id at all"),
    (11, "<|endoftext|> in <|startoftext|> text ▁ <s> <0x41>"),
    (12, "don't we'll 'RE  two   spaces\r\n\x0b\x1c\x85"),
]


def by_id(df, key="doc_id"):
    """Rows by id; repeated rows must agree."""
    out = {}
    for row in df.collect():
        out.setdefault(row[key], []).append(row.asDict())
    return out
