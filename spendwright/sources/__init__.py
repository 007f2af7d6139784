"""Table contracts, readers, writers and the table catalog."""
