"""User-level products: histories, wind tables, progenitors, galaxy trees, sight lines."""
