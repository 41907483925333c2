"""Document analytics on Spark: office documents as relational tables, and the operators that work on them."""
