"""Which jobs may get which other ids: a plan over the graph of old and new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.leaves import written


def rekey_plan(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """(job_id, new_id, kind) for moves (job_id, new_id) of jobs that are there and get another id.

    kind: `free`, nobody has the new id; `chain`, its holder moves away as well; `cycle`, the
    holder moves away and the ids lead back to the job; `clash`, the holder stays or several jobs
    want the id. A job can wait for one id only, so what is no clash forms chains and cycles. Those
    are told apart by doubling steps: after k rounds each job knows the one 2**k steps on, and
    once no more jobs run out of steps, those that are left lie on cycles.
    """
    there = jobs.select("job_id").distinct()
    m = moves.select("job_id", "new_id").distinct().where("not (job_id <=> new_id)").join(there, "job_id", "left_semi")
    wanted = m.groupBy("new_id").agg(F.count("*").alias("n"))
    holders = there.join(m.select("job_id", F.lit(True).alias("leaves")), "job_id", "left").select(F.col("job_id").alias("new_id"), F.coalesce("leaves", F.lit(False)).alias("leaves")).distinct()
    several = m.groupBy("job_id").agg(F.count("*").alias("ids"))
    known = m.join(several, "job_id").join(wanted, "new_id").join(holders, "new_id", "left")
    clash = (F.col("n") > 1) | (F.col("ids") > 1) | ~F.coalesce("leaves", F.lit(True))
    plan = written(known.select("job_id", "new_id", F.when(clash, "clash").when(F.col("leaves"), "chain").otherwise("free").alias("kind")))
    # who waits for whom, without clashes: what a clash holds up is a chain that ends there
    step = written(plan.where("kind <> 'clash'").select(F.col("job_id").alias("a"), F.col("new_id").alias("b")))
    ahead, n = step, step.count()
    while n:
        further = written(ahead.join(ahead.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        before, n, ahead = n, further.count(), further
        if n == before:
            break
    on = ahead.select(F.col("a").alias("job_id"), F.lit(True).alias("round"))
    return plan.join(on, "job_id", "left").select("job_id", "new_id", F.when((F.col("kind") == "chain") & F.col("round"), "cycle").otherwise(F.col("kind")).alias("kind"))
