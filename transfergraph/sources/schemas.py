"""Row types of the ledger as DDL, so that importing needs no session; amounts are whole numbers of the smallest unit in 128 bits."""

AMOUNT = "decimal(38,0)"
#: One display unit in the smallest units.
UNIT = 10**12

TRANSFERS = (
    f"hash string, block_number long, timestamp timestamp, from_address string, to_address string, value {AMOUNT}, fee {AMOUNT}, success boolean, method string, section string"
)
ACCOUNTS = (
    "address string, public_key string, identity struct<display:string,legal:string,web:string,email:string,twitter:string,riot:string,verified:boolean>, "
    f"balance {AMOUNT}, first_seen_block long, last_seen_block long, risk_score double, tags array<string>, created_at timestamp"
)
EDGES = (
    f"from_address string, to_address string, transfer_count long, total_volume {AMOUNT}, first_transfer_block long, last_transfer_block long, first_transfer_time timestamp, last_transfer_time timestamp"
)
#: Explorer exports: one JSON object a line.
API_TRANSFER = ("hash string, block_num long, block_timestamp long, `from` string, `to` string, amount string, amount_v2 string, fee string, success boolean, module string, asset_symbol string")
API_ACCOUNT = (
    "address string, balance string, account_display struct<address:string,display:string,identity:boolean,judgements:array<struct<index:int,judgement:string>>,"
    "parent:struct<address:string,display:string,sub_symbol:string>,people:struct<display:string>,merkle:struct<address_type:string,tag_type:string,tag_subtype:string,tag_name:string>>"
)
BLOCK = (
    "number long, hash string, parent_hash string, timestamp timestamp, "
    "extrinsics array<struct<index:int,hash:string,signer:string,section:string,method:string,args:struct<dest:string,value:string>>>, "
    "events array<struct<extrinsic:int,section:string,method:string,data:struct<`from`:string,`to`:string,amount:string,fee:string>>>"
)
LOG_LINE = (
    "time timestamp, level string, context string, msg string, requestId string, duration double, operation string, type string, statusCode int, error struct<name:string,type:string>, _corrupt_record string"
)
