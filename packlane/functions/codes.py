"""Every diagnostic code, and the category and exit status that its first two segments give."""

from __future__ import annotations

#: Family -> last segments.
FAMILIES = {
    "archive.truncated": "central_directory local_header entry_data data_descriptor",
    "archive.over_limit": "archive_bytes entries name_bytes entry_decoded_bytes total_decoded_bytes compression_ratio extra_field_bytes comment_bytes",
    "archive.malformed": "eocd_missing trailing_bytes central_directory_placement central_directory_count central_directory_size record_signature local_header_mismatch data_descriptor_mismatch declared_size_mismatch crc_mismatch deflate_stream overlapping_ranges prefix_bytes unclaimed_bytes",
    "archive.ambiguous": "eocd duplicate_name case_folded_duplicate_name",
    "archive.unsupported": "encryption patched_data method multi_disk zip64",
    "archive.unsafe_name": "empty control_byte backslash absolute_path drive_prefix parent_component directory_with_data",
    "archive": "no_such_entry",
    "metadata.unsupported": "dtd processing_instruction encoding namespace",
    "metadata.malformed": "syntax encoding entity unbound_prefix attribute root_element missing_element duplicate_element element_order unexpected_child enumeration integer boolean marker_missing marker_not_first marker_content",
    "metadata.over_limit": "document_bytes depth elements attributes_per_element text_bytes",
    "metadata": "missing count_mismatch",
    "metadata.ambiguous": "multiple_candidates",
    "metadata.reference": "missing_entry duplicate",
    "extract.unsupported": "link special_file non_utf8_name",
    "extract.unsafe_path": "empty_component current_component parent_component control_character trailing_dot trailing_space leading_space reserved_device_name colon reserved_character",
    "extract.ambiguous": "collision file_directory_conflict",
    "extract.over_limit": "files total_bytes path_bytes component_bytes depth",
    "create.invalid": "unknown_elements dispatch_count reference_mismatch text untrimmed_text timestamp",
    "create.over_limit": "archive_bytes entries name_bytes entry_bytes total_bytes compression_ratio",
    "create.unsafe_name": "empty separator control_character current_component parent_component trailing_dot trailing_space leading_space reserved_device_name colon reserved_character",
    "create.internal": "self_check_failed",
    "repack.unsupported": "metadata_missing root_prefix metadata_name marker extra_entry unknown_elements opaque_block dispatch_count attachment_entry attachment_reference",
    "repack.invalid": "no_such_attachment duplicate_target inventory_mismatch",
    "repack.internal": "self_check_failed",
    "manifest.invalid": "syntax schema_version missing_field unknown_field type enumeration timestamp",
    "input": "unreadable over_limit.archive_bytes",
    "output": "destination_missing destination_not_a_directory destination_symlink exists io not_a_directory partial_marker_present symlink_in_path",
}

CODES = tuple(sorted(f"{family}.{last}" for family, ends in FAMILIES.items() for last in ends.split()))

#: Exit status by category: fixed values.
STATUS = {"success": 0, "usage": 2, "inconsistent": 3, "unresolved": 4, "input": 5, "package": 6, "unsupported": 7, "limit": 8, "output": 9}

#: Categories of second segments; input and output go by their first.
SECOND = {
    "over_limit": "limit",
    "unsupported": "unsupported",
    "missing": "inconsistent", "reference": "inconsistent", "count_mismatch": "inconsistent",
    **dict.fromkeys(("truncated", "malformed", "ambiguous", "unsafe_name", "no_such_entry", "invalid", "internal", "unsafe_path"), "package"),
}


def category(code: str) -> str:
    first, second = code.split(".")[:2]
    return first if first in ("input", "output") else SECOND[second]
