"""Rows of Spark and DuckDB made comparable."""


def rows_of(frame):
    """Rows as sorted tuples of plain values, columns in order of name."""

    def plain(x):
        if x is None or x != x:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return round(float(x), 6)
        return str(x)

    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple(float(v) if isinstance(v, str) and v.lstrip("-").isdigit() else v for v in map(plain, row)))
    return sorted(out, key=repr)
