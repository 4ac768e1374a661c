"""plans of loomrank."""
