"""Reading datasets from storage and writing them back."""
