from collections import Counter


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())
