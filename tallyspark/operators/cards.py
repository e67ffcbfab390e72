"""Card payments without a mask: which card account a payment settles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.statements import outstanding, parsed


def resolve_payments(payments: DataFrame, accounts: DataFrame, uploads: DataFrame, today: str) -> DataFrame:
    """id, account_id and step of payments (id, bank, amount): the bank's only card, the only card whose latest total is the
    amount, the only one whose outstanding amount is, the only one that owes at least so much; else null.  Where a card of
    the bank has no readable statement the last two are not tried."""
    cards = accounts.where(F.col("type") == "credit_card").select(F.col("id").alias("card"), F.col("bank").alias("b"))
    owed = outstanding(uploads, today).select(F.col("account_id").alias("_o"), F.col("statement_id"), "outstanding_paise")
    total = parsed(uploads).where("amount_due is not null").select(F.col("id").alias("_s"), (F.col("amount_due") * 100).cast("bigint").alias("total_paise"))
    state = cards.join(owed, F.col("card") == F.col("_o"), "left").join(total, F.col("statement_id") == F.col("_s"), "left").select("b", "card", "total_paise", F.when(F.col("total_paise").isNotNull(), F.col("outstanding_paise")).alias("owed"))
    only = state.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.max("card").alias("sole"), F.bool_or(F.col("owed").isNull()).alias("uncovered"), F.count_if(F.col("owed") > 0).alias("owing"), F.max(F.when(F.col("owed") > 0, F.struct("owed", "card"))).alias("debtor"))
    by_total = state.where("total_paise is not null").groupBy("b", "total_paise").agg(F.count(F.lit(1)).alias("tn"), F.max("card").alias("tc")).where("tn = 1").withColumnRenamed("b", "tb")
    by_owed = state.where("owed > 0").groupBy("b", "owed").agg(F.count(F.lit(1)).alias("on"), F.max("card").alias("oc")).where("on = 1").withColumnRenamed("b", "ob")
    p = payments.withColumn("paise", (F.col("amount") * 100).cast("bigint"))
    j = p.join(only, F.col("bank") == F.col("b"), "left").join(by_total, (F.col("bank") == F.col("tb")) & (F.col("paise") == F.col("total_paise")), "left").join(by_owed, (F.col("bank") == F.col("ob")) & (F.col("paise") == F.col("owed")), "left")
    sole = F.when(F.col("n") == 1, F.col("sole"))
    exact = F.when(~F.col("uncovered"), F.col("oc"))
    least = F.when(~F.col("uncovered") & (F.col("owing") == 1) & (F.col("paise") <= F.col("debtor.owed")), F.col("debtor.card"))
    step = F.when(sole.isNotNull(), "sole_card").when(F.col("tc").isNotNull(), "total_due").when(exact.isNotNull(), "outstanding").when(least.isNotNull(), "sole_outstanding")
    return j.select("id", F.coalesce(sole, F.col("tc"), exact, least).alias("account_id"), step.alias("step"))
