"""Rows with the cases every operator must stand."""

#: Texts with the cases every operator must stand: null, empty, repeated, very long, odd characters.
ODD = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, "one two three four five six seven"), (5, "x" * 50_000),
    (6, "word " * 20_000), (7, "\x00\n 　 é  😀 it's <|endoftext|> 'tis"), (8, " "), (9, "\n\n\n"), (None, "one two three four five six seven"), (1, "one two three four five six seven"),
]
