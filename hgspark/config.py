"""Defaults shared by operators, providers and the command line."""

VERSION = "0.1.0"
CHUNK_SIZE = 1000
SPLITTER_CHUNK_SIZE = 2500
CHUNK_OVERLAP = 0
TEMPERATURE = 0.333
KEYWORD_TEMPERATURE = 0.1
ANSWER_TEMPERATURE = 0.7
MERGE_THRESHOLD = 0.9
MIN_EDGE_SIZE = 2
MATCH_THRESHOLD = 0.5
TOP_K = 5
PATH_NODES = 4
CONTEXT_TOKENS = 2000
MAX_SENTENCES = 50
PREVIEW_CHARS = 200
EMBEDDING_BATCH = 100
REQUEST_SECONDS = 300
ANSWER_TOKENS = 8192
CHAT_MODEL = "gpt-oss:20b"
EMBEDDING_MODEL = "nomic-embed-text:v1.5"
#: Rows up to which a table whose size was counted is marked for broadcast.
BROADCAST_ROWS = 200_000
