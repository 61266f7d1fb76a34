"""Training-data operators: each module holds one operator with its query
function ``query(spark, sf_dir)``; ``registry`` lists the queries and their SQL.
Nothing outside this subpackage imports it."""
