"""Sources: each module reads documents of one publisher and gives pages in the common schema."""
