"""Small tables with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

BASE = "the quick brown fox jumps over the lazy dog while ann writes to the office about seven new orders and waits for a reply"


def awkward(spark):
    long_text = " ".join(f"w{i}x{i % 7}" for i in range(30_000)) + "\nReleased under the MIT License."
    rows = [
        (1, BASE, "en", "a"),
        (2, BASE, "en", "a"),
        (2, BASE, "en", "a"),
        (3, BASE + " today", "en", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, "   \n\t ", None, "c"),
        (7, long_text, "xx", "b"),
        (8, "x" * 200_000, "en", "c"),
        (9, "mail ann@shop.example or +1 (212) 555-0147, card 4111 1111 1111 1111 1 at 10.0.0.1", "en", "c"),
        (10, "le chat est dans la maison avec un enfant 😀 çé", "fr", None),
        (11, "12345 !!! 67890", "en", ""),
        (None, "a row without an id, but with words enough to be judged", "en", "a"),
        (12, "two words", None, "a"),
    ]
    # Columns that operators add or join by, as the table's own.
    extra = ("ids string, n_tokens string, media string, spans string, base_spans string, sanitised string, licenses string, lang_pred string, score string, component_id string, n string, "
             "payload string, n_bytes string, copies string, taken string, of string, key string, part string, words string, text_key string, count string, term string")  # fmt: skip
    n = len(extra.split(", "))
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *(["own"] * n)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def empty(spark):
    return awkward(spark).limit(0)
