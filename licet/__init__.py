"""licet: a Spark analytics engine in which facts about columns license faster plans."""
