"""Fixed values that results depend on; stated as text, never derived."""

# Special token names, in id order.
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]

# Pre-token pattern: numbers in pieces of one or two digits.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""

# Token-shard file header: 256 int32 values, of which the first three are used.
SHARD_MAGIC = 20240520
SHARD_VERSION = 1
SHARD_HEADER_INTS = 256
# BOS id written in GPT-2 token shards.
SHARD_BOS_ID = 50256

# Corpus shards are numbered 0..1822.
MAX_SHARD = 1822
SHARD_NAME_FORMAT = "shard_%05d.parquet"

# Report sections in the order they are put together.
EXPECTED_SECTIONS = [
    "tokenizer-training",
    "tokenizer-evaluation",
    "base-model-training",
    "base-model-loss",
    "base-model-evaluation",
    "midtraining",
    "chat-evaluation-mid",
    "chat-sft",
    "chat-evaluation-sft",
    "chat-rl",
    "chat-evaluation-rl",
]

# Chat metrics looked for in evaluation sections.
CHAT_METRICS = ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE"]

# Accelerator price per hour, in matching order, and the price of any other device.
HOURLY_RATES = [
    ("H100", 3.00),
    ("A100", 1.79),
    ("V100", 0.55),
    ("TPU v4", 3.22),
    ("TPU v5", 4.20),
]
DEFAULT_HOURLY_RATE = 2.0

# Facts looked for in log text: sizes and shares, and shard numbers.
LOG_AMOUNT_PATTERN = r"(\d+\.?\d*\s*(?:GB|MB|%|docs))"
LOG_SHARD_PATTERN = r"Shard (\d+)"

# Token ids are stored as unsigned 16-bit values.
MAX_TOKEN_IDS = 65_536
