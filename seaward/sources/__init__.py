"""Reading and writing: station files in the CODAR tabular format, catalogues, Parquet and CSV."""
