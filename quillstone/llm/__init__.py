"""Training-data operators. Nothing else in quillstone imports this subpackage."""
