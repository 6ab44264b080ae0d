"""Rule checks: messages for each subject of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, spec: dict[str, dict[str, Column | str]]) -> DataFrame:
    """Add ``isvalid`` and, for each subject, an array of messages of failed rules (null if none).

    A rule is a boolean; one that is false or null fails with its message. A
    rule may be text instead, which is then the message itself unless null.
    """
    found = {}
    for subject, rules in spec.items():
        failed = []
        for message, rule in rules.items():
            test = F.expr(rule) if isinstance(rule, str) else rule
            failed.append(F.when(~F.coalesce(test, F.lit(False)), F.lit(message)))
        messages = F.filter(F.array(*failed), lambda x: x.isNotNull())
        found[subject] = F.when(F.size(messages) > 0, messages)
    valid = F.lit(True)
    for c in found.values():
        valid = valid & c.isNull()
    return df.select("*", valid.alias("isvalid"), *[c.alias(k) for k, c in found.items()])
