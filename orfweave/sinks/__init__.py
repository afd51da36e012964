"""Writers of gene calls and graphs."""
