"""Reading results in tests."""


def values(df, column="value"):
    return [r[column] for r in df.collect()]
