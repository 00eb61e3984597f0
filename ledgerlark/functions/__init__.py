"""Part of the ledgerlark library."""
