"""What several tests use."""


def rows(df, *order):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)
