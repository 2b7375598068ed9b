"""Reading subject tables, feature lists and run matrices; writing results."""
