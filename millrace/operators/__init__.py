"""DataFrame operators: analytics, mutations, knowledge, reliability."""
