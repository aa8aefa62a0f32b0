"""Readers of repository files."""

from .files import commits, config, config_last, loose_objects, mailbox, mailmap, mapped_identities, pack_index, packed_objects, packed_refs, patches, staging_index, tree_entries

__all__ = ["commits", "config", "config_last", "loose_objects", "mailbox", "mailmap", "mapped_identities", "pack_index", "packed_objects", "packed_refs", "patches", "staging_index", "tree_entries"]
