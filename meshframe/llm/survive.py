"""Best representative of each duplicate group: field-by-field survivorship.

One aggregation: per group and attribute the maximum of a composite struct (present, source trust, date, smaller id,
value). Structs compare field by field and null is smallest, so the maximum is the row that survives, and it carries its
value. Partial maxima are combined before the shuffle, so a group that holds a third of all rows sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.functions.presence import canonical_uid, list_present, text_present
from meshframe.runtime import checked_broadcast


def survivors(rows: DataFrame, group: Column, rec: Column, fields: dict[str, tuple[Column, Column]], order: list[Column], at_least: int = 1) -> DataFrame:
    """(uid, n_rows, one struct column a field: rec_id, value): per group the value that survives.

    fields: name -> (value, is it present). order: what ranks rows with the field present, the best is the largest; ties
    go to the smallest rec. A field that no row has is a null struct. Rows with a null group are dropped.
    """
    cols = [group.alias("uid"), rec.alias("__rec"), *[c.alias(f"__o{i}") for i, c in enumerate(order)]]
    cols += [c.alias(f"__{what}_{name}") for name, (value, there) in fields.items() for what, c in (("v", value), ("p", there))]
    x = rows.select(*cols).where("uid is not null")
    best = {
        name: F.max(F.when(F.col(f"__p_{name}"), F.struct(*[F.col(f"__o{i}") for i in range(len(order))], (-F.col("__rec")).alias("neg"), F.col(f"__v_{name}").alias("value"))))
        for name in fields
    }
    out = x.groupBy("uid").agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(name) for name, c in best.items()]).where(F.col("n_rows") >= at_least)
    return out.select("uid", "n_rows", *[F.when(F.col(name).isNotNull(), F.struct((-F.col(name)["neg"]).alias("rec_id"), F.col(name)["value"].alias("value"))).alias(name) for name in fields])


def node_survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """Survivors of node_record by canonical UID: node_value, name, str_metric each from the best row that has them.

    A feed that is null or not in `trust` ranks below all, then the latest date (null earliest), then the smallest rec_id.
    """
    t = trust.where("feed is not null").groupBy(F.col("feed").alias("__feed")).agg(F.max("trust").alias("__trust"))
    x = records.select("rec_id", "uid", "node_value", "meta").join(checked_broadcast(t), F.col("meta.feed") == F.col("__feed"), "left")
    name, metric, value = F.col("meta.name"), F.col("meta.str_metric"), F.col("node_value")
    fields = {"node_value": (value, list_present(value)), "name": (name, text_present(name)), "str_metric": (metric, text_present(metric))}
    order = [F.col("__feed").isNotNull(), F.col("__trust"), F.col("meta.date_metric")]
    return survivors(x, canonical_uid(F.col("uid")), F.col("rec_id"), fields, order, at_least=2)
