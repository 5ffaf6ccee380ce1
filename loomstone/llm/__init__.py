"""Training-data operators: vectors, splitting, conversations, e-mail, privacy, tokens, mixing, text forms.

Nothing outside this package imports it. ``loomstone.llm.queries`` holds the registered
queries; each operator module can be used on any DataFrame with the columns it names.
"""
