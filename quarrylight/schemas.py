"""Fixed limits and defaults."""

# Limits and defaults that results depend on.
MAX_SOURCE_BYTES = 8 << 20
MAX_ARTIFACT_BYTES = 64 << 20
MAX_LINES = MAX_UNITS = 1_000_000
PREFERRED_UNIT_BYTES, MAX_UNIT_BYTES = 16_384, 65_536
MAX_QUERY_BYTES, MAX_ITEMS, EXCERPT_BYTES, EXCERPT_BEFORE = 4096, 64, 512, 128
PAGE_ITEMS, EXPANSION_BYTES, WINDOW_TTL_S, FRAME_BYTES = 16, 65_536, 120, 8 << 20
MAX_LOCATOR_BYTES = 65_536
MAX_UNITS_PER_SOURCE, MAX_RETIRED = 2, 8
CLASS_WEIGHTS = {"primary": 1.0, "documentation": 0.65, "vendor": 0.35}
#: Digests of a broadcast at most, and bytes of text of one part of an index.
BROADCAST_KEYS, PART_BYTES = 250_000, 16 << 20
#: Bytes of text above which an index is built slice by slice, and slices at most.
SLICE_BYTES, MAX_SLICES = 64 << 20, 8
BM25_K, BM25_B = 1.2, 0.75
GAPS = ("binary_content", "invalid_utf8", "input_too_large", "output_too_large", "too_many_lines", "too_many_units", "unit_too_large", "artifact_too_large")
