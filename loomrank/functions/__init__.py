"""functions of loomrank."""
