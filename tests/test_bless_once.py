"""A variant decided at many places meets the dictionary once."""

from parley.operators import corrections as co


def test_variants_are_counted_before_the_dictionary_is_asked(spark):
    held = spark.createDataFrame([("w1", "Mia", "mya")], "world string, canonical string, variant string")
    asked = spark.createDataFrame([("w1", "Mia", "MYA"), ("w1", "MIA", "Mea"), ("w1", "Mia", "mea"), ("w1", "Mia", "mea"), ("w1", "Mia", "mia"), ("w2", "Mia", "mya")],
                                  "world string, canonical string, heard string")
    out = co.bless(held, asked)
    assert sorted(tuple(r) for r in out.collect()) == [("w1", "MIA", "Mea"), ("w1", "Mia", "mya"), ("w2", "Mia", "mya")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate")
