"""inkwell: DataFrame operators for streams of published content."""
