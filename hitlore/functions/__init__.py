"""Column helpers; everything here is a Catalyst expression unless its name says otherwise."""
