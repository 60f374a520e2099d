"""tallymill: a layered transaction-analytics engine written as Spark plans."""
