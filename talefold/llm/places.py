"""Where the tokenizer files lie: a parameter of the operators that need them."""


def tokenizer(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The JSON file and the file of ranks of a public tokenizer that is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")
