"""The operators, from normalised events to evaluated alerts."""
