"""Fixed values of the format and of the engine's defaults."""

# RFC 1951, 1952 and the two sized-member conventions.
MAGIC = b"\x1f\x8b"
METHOD_DEFLATE = 8
RESERVED_FLAGS = 0xE0
FHCRC, FEXTRA, FNAME, FCOMMENT = 2, 4, 8, 16
HEADER_LEN = 10
TRAILER_LEN = 8
NAME_MAX = 256
OS_UNIX = 3
MARKER = b"\x00\x00\xff\xff"
EMPTY_BLOCK = b"\x00\x00\x00\xff\xff"
MARKER_PAIR = MARKER + EMPTY_BLOCK
FINAL_EMPTY_BLOCK = b"\x01\x00\x00\xff\xff"

# zlib's strategies by name.
STRATEGIES = {"default": 0, "filtered": 1, "huffman": 2, "rle": 3, "fixed": 4}

DEFAULT_LEVEL = 7
DEFAULT_BLOCK = 128 << 10
MAX_BLOCK = 256 << 20
PROBE_WINDOW = 1 << 20
COALESCE_TARGET = 128 << 10
HEADER_BUFFER_MAX = 1 << 20  # members with longer headers are decoded as streams
SPAN_MIN, SPAN_MAX = 4096, 16 << 20
STREAM_SYNC_SPAN = 4096
PATH_MAX = 4096
SUFFIX = ".gz"

# Outcomes, from best to worst.
OK, WARNING, ERROR = "ok", "warning", "error"
U32 = 0xFFFFFFFF
