"""Relational operators over text columns: spans, tokens, owners, dictionaries, audit."""
