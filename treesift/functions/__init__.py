"""Part of treesift."""
