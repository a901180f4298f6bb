"""Fixed values of the matching contract and engine defaults.

Everything in the first block must stay equal to the behaviour we mirror:
which names are ignored, which suffixes count as images and the default
Hamming threshold.
"""

# --- fixed values (contract; do not change) ---------------------------------
IGNORED_FILE_NAMES = (".DS_Store",)
IGNORED_NAME_PREFIXES = ("._",)
IGNORED_DIR_NAMES = (".Trash", ".Spotlight-V100", ".fseventsd")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".webp", ".tif", ".tiff")
DEFAULT_THRESHOLD = 8
DEFAULT_CHUNK_SIZE = 256 * 1024
RESULT_COLUMNS = (
    "target_path",
    "action",
    "match_path",
    "match_type",
    "distance_or_hash",
    "reason",
)
STATS_COLUMNS = ("total_scanned", "copied", "exact_duplicates", "phash_duplicates", "skipped")
# Pillow's default decompression-bomb limit; only images above twice the limit fail.
DEFAULT_MAX_IMAGE_PIXELS = int(1024 * 1024 * 1024 // 4 // 3)

# --- engine defaults (ours) -------------------------------------------------
HASH_PREFIX_LEN = 16
LSH_BANDS = 4  # four 16-bit chunks, chunk 0 = lowest bits
FINGERPRINT_BITS = 64
