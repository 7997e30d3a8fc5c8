from topicloom.llm import queries

FOUND = {"p2_found": ["row_id_a", "row_id_b"], "p3_found": ["tab", "id_a", "id_b"], "p4_found": ["tab", "rec_id", "language"], "p5_found": ["tab", "rec_id"], "p6_found": ["token", "mark"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind"]}


def test_columns(spark):
    for name, columns in FOUND.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns
