from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from colonnade.operators import models, target
from colonnade.plans import training


def test_a_model_scores_every_row_once(spark):
    df = spark.createDataFrame([(i, i / 300, i % 2) for i in range(300)], "k int, f double, y int")
    run = training.start_run(df, "y", ["k"], target.BINARY)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(label):
        seen.add(1)
        return 0.25 + label / 2

    class Scorer:
        def transform(self, rows):
            p = counted("label")
            return rows.withColumn("p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("p"), F.col("p")))).withColumn("prediction", F.col("label"))

    run.models["m"] = Scorer()
    found = run.metrics("m", "train", "validation")
    assert found["train"]["roc_auc"] == found["validation"]["accuracy"] == 1.0
    assert seen.value == run.rows["train"] + run.rows["validation"]
    seen.value = 0
    fixed = models.Candidate("m", "mllib", lambda: type("Fixed", (), {"fit": lambda self, _: Scorer()})())
    assert training._score_on_part(run, fixed, run.fold("train")) == 1.0 and seen.value == run.rows["validation"]
