"""Token rules and parsing-expression grammars of the languages."""
