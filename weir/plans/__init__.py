"""From SQL text to logical plans to DataFrames."""
