"""Query text to a checked plan: lexer, parser, nodes. Plain Python; nothing here needs Spark."""
