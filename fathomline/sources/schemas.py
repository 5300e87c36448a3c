"""Declared schemas of every source; nothing is inferred."""

from __future__ import annotations

ASSET = "struct<asset_type:string,asset_code:string,asset_issuer:string>"
LEVEL = "struct<price_r:struct<n:string,d:string>,price:string,amount:string>"
ORDER_BOOK = f"struct<bids:array<{LEVEL}>,asks:array<{LEVEL}>,base:{ASSET},counter:{ASSET}>"
RESERVE = "struct<asset:string,amount:string>"
POOL = f"struct<id:string,fee_bp:int,reserves:array<{RESERVE}>,last_modified_ledger:bigint>"
POOL_PAGE = f"struct<_embedded:struct<records:array<{POOL}>>>"
TRADE = (
    "struct<id:string,paging_token:string,ledger_close_time:timestamp,trade_type:string,base_offer_id:string,counter_offer_id:string,base_account:string,counter_account:string,"
    "base_amount:string,counter_amount:string,base_asset_type:string,base_asset_code:string,base_asset_issuer:string,counter_asset_type:string,counter_asset_code:string,counter_asset_issuer:string,"
    "base_is_seller:boolean,base_liquidity_pool_id:string,counter_liquidity_pool_id:string,liquidity_pool_fee_bp:int,price:struct<n:string,d:string>>"
)
RECORDING = (
    "struct<schema_version:int,pair:string,recorded_at:string,ledger_before:bigint,ledger_after:bigint,ledger_consistent:boolean,"
    "sources:array<struct<endpoint:string,url:string,http_status:int,body:string,body_sha256:string,error:string>>>"
)
TRADES_CSV = (
    "trade_id string, operation_id string, fill_index int, ledger_seq bigint, closed_at timestamp, trade_type string, price_n bigint, price_d bigint, price_quote_per_base decimal(38,18), base_amount decimal(19,7), "
    "counter_amount decimal(19,7), base_is_seller boolean, base_account string, counter_account string, base_offer_id string, counter_offer_id string, liquidity_pool_id string, liquidity_pool_side string, liquidity_pool_fee_bp int"
)
HOLDERS_CSV = "account_id string, balance decimal(19,7), last_modified_ledger bigint, latest_ledger bigint, source_page string, read_at_utc timestamp"
ACCOUNT = "struct<account_id:string,last_modified_ledger:bigint,balances:array<struct<balance:string,asset_type:string,asset_code:string,asset_issuer:string,is_authorized:boolean,buying_liabilities:string,selling_liabilities:string>>>"
ASSET_STAT = (
    "struct<asset_type:string,asset_code:string,asset_issuer:string,amount:string,num_accounts:bigint,accounts:struct<authorized:bigint,authorized_to_maintain_liabilities:bigint,unauthorized:bigint>,"
    "balances:struct<authorized:string,authorized_to_maintain_liabilities:string,unauthorized:string>,num_liquidity_pools:bigint,liquidity_pools_amount:string,num_claimable_balances:bigint,claimable_balances_amount:string,"
    "num_contracts:bigint,contracts_amount:string,flags:struct<auth_required:boolean,auth_revocable:boolean,auth_immutable:boolean,auth_clawback_enabled:boolean>>"
)
POOL_EFFECT = f"struct<paging_token:string,type:string,created_at:timestamp,liquidity_pool:struct<id:string,fee_bp:int,reserves:array<{RESERVE}>>>"
REMOVAL = "offer_id bigint, gone_by_ledger bigint, evidence string, why string"
POOL_EVIDENCE = (
    "struct<Base:struct<Code:string,Issuer:string,Type:string>,Quote:struct<Code:string,Issuer:string,Type:string>,LedgerSeq:bigint,LedgerClosedAt:timestamp,Source:string,"
    "Pools:array<struct<PoolID:string,ReserveBase:string,ReserveQuote:string,FeeBP:int>>>"
)
OFFER = f"struct<id:string,seller:string,selling:{ASSET},buying:{ASSET},amount:string,price_r:struct<n:string,d:string>,last_modified_ledger:bigint>"
