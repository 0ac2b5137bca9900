from __spark_entry__ import ALL

SF = "/root/testdata/sf0.01"


def test_every_row_with_a_description_is_explained(spark):
    wanted = ALL["feature_table"].run(spark, SF).filter("description <> ''").count()
    assert wanted > 200
    for name in ("explanation_rows", "all_explanation_rows", "explanations_xml_round_trip", "all_explanations_xml_round_trip"):
        assert " LIMIT " not in ALL[name].sql[-40:]
        assert ALL[name].run(spark, SF).count() == wanted
