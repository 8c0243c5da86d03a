"""Reading tables and files, and the dataset catalog."""
