"""Rows that every operator must take: nulls, empty and long texts, repeats."""

LONG = "lorem ipsum dolor " * 20_000
HARD = [
    (1, "a short text with some words in it", "en"),
    (1, "a short text with some words in it", "en"),
    (None, "a text without an id but with words", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, LONG, None),
    (6, "é日本 😀 ſK İx", None),
    (None, None, None),
]
