"""From statements to DataFrames: syntax, predicates, planning and size estimates."""
