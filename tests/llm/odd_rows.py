"""Rows that every operator has to stand."""

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!?"), (None, "a text without a key"), (5, "same row"), (5, "same row"), (6, "é中🙂 x")]
