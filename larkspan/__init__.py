"""larkspan: PostgreSQL-flavoured analytics expressed as Spark plans."""
