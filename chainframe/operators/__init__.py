"""DataFrame → DataFrame operators (diff, derive, balances, utxo, prices, abi, metrics, alerts)."""
