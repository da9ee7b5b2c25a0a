"""Plans: JSON programs over named tables, checked and compiled to one lazy DataFrame."""
