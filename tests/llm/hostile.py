"""Documents with everything that may go wrong."""

LONG = " ".join(f"wort{k % 977} thing{k % 31}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, position double, rank int, words array<string>"


def rows(extra=()):
    texts = ["", None, "   \n\t", "one", "the cat sat on the mat and the dog", "the cat sat on the mat and the dog", LONG, "x" * 50_000, "$$$ ### !!!", "+1 (743) 555-3824 a@b.example.com"]
    out = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 2}", None, "k", 0.5, 1, ["a"]) for k, t in enumerate([*texts, *extra])]
    out.append(out[4])  # a repeated row
    out.append((None, "no identifier", None, None, None, None, None, None, None))
    return out


def documents(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
