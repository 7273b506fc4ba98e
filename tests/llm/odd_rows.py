"""Rows that every operator must stand."""

#: Nulls, empty and blank texts, long ones, repeated rows and ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "x" * 70_000), (6, "ab cd ef gh " * 9_000), (7, "a\n\nb\r\nc"), (8, "Ünï cödé 漢字 😀 " * 30), (None, None)]
