"""Driver-side configuration and fixed values.

Configuration is a frozen dataclass on the driver; nothing here is a table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference tokenizer layout).
# Ids 0-2 are the trainer's own pieces, ids 3-6 the user-defined specials
# in the order the training code registers them.
# ---------------------------------------------------------------------------
SPECIAL_PIECES = ("<unk>", "<s>", "</s>", "[PAD]", "[UNK]", "[SOS]", "[EOS]")
UNK_ID = 0
PAD_ID = 3
SOS_ID = 5
EOS_ID = 6
# Literal special texts whose presence in raw text is reported by Q2.
USER_SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]")
# Word-start marker used by the subword normaliser.
WORD_MARK = "▁"


@dataclass(frozen=True)
class PrepConfig:
    """Defaults are the reference code's values (not its README's)."""

    seq_len: int = 128
    batch_size: int = 8
    val_batch_size: int = 1
    num_epochs: int = 20
    train_ratio: float = 0.9
    seed: str = "42"
    src_lang: str = "en"
    tgt_lang: str = "zh"
    vocab_size: int = 32000
    eval_every: int = 500
    n_examples: int = 2
    model_basename: str = "tmodel_"
    # B2: the reference cuts batches before dropping long rows.
    filter_first: bool = False
    # Tokenizers are fitted on all rows, before the split.
    fit_on: str = "all"

    def with_(self, **kw) -> "PrepConfig":
        return replace(self, **kw)


def tokenizer_path(template: str, lang: str) -> str:
    """Tokenizer file name for a language.

    Uses ``removesuffix`` so that ``tokenizer_de.model`` keeps its language
    (a character-set strip would eat the ``de``).
    """
    path = template.format(lang)
    for suffix in (".json", ".model"):
        path = path.removesuffix(suffix)
    return path
